"""Trade-history analytics on Spark: ingest, integrity, lifecycle, bars, features, research and monitoring."""
