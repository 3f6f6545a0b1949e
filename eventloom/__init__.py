"""Product analytics on Spark: clean, enrich, roll up and query event data."""
