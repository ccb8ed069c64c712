"""Spatial-keyword retrieval and corpus preparation on PySpark."""
