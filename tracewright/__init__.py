"""Bus-signal analytics on PySpark."""
