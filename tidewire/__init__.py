"""News-stream analytics and corpus preparation on PySpark."""
