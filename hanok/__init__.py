"""Housing-transaction analytics on Spark: operators, jobs, sources and sinks."""
