"""Single-cell image analytics as Spark DataFrame operations."""
