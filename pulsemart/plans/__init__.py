"""Named pipelines: silver facts, gold marts, features, dashboards, checks, monitoring, audit."""
