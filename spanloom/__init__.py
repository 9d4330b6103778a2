"""Document text as Spark tables."""
