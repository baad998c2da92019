"""A payments lakehouse written as plain PySpark DataFrame jobs."""
