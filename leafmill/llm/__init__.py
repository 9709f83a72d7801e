"""Training-data operators: tokenisation, deduplication, scans, scoring and extraction on Spark."""
