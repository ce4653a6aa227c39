"""The registered queries, one module per section, keyed by operator id."""
