"""Streams and tables on PySpark: plain functions from DataFrame to DataFrame."""
