"""offerlane: analytics over priced offers, written as PySpark DataFrame, SQL and streaming jobs."""
