"""Web-traffic analytics as PySpark DataFrame operators and streaming jobs."""
