"""Point-in-polygon classification and its aggregates as Spark DataFrame operations."""
