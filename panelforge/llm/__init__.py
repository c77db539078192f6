"""Training-data operators: mixing, filtering, joins, scans and deduplication of document tables."""
