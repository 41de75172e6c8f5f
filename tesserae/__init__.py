"""Batch-first retrieval, table analytics and corpus processing on PySpark."""
