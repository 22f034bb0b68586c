"""Municipal records on Spark: sources, place annotation, search, history and reports as DataFrame jobs."""
