"""Training-data operators: deduplication, scoring, redaction, tokenising, packing."""
