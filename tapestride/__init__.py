"""tapestride: market-tape analytics and corpus preparation on PySpark."""
