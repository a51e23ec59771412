"""Screening of feature tables for out-of-distribution rows, as PySpark jobs."""
