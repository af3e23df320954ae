"""Area feature tables on Spark: clean, key, aggregate, assemble, train, judge."""
