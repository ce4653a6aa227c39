"""pulsemart: clinical, claims and platform-log analytics as Spark DataFrame jobs."""
