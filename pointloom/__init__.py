"""Point-cloud analytics as PySpark DataFrame operations."""
