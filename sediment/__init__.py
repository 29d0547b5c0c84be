"""Event tables on Spark: ingest, deduplicate, retain, correct and report."""
