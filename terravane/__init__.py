"""Repository-intelligence analytics on PySpark."""
