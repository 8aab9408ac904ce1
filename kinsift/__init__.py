"""Duplicate resolution for large catalogues of files and records, as Spark DataFrame jobs."""
