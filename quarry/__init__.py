"""A document corpus engine on Spark: ingest, chunk, index and search text at scale."""
