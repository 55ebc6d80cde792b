"""tilequery: slide-pyramid queries and data operators as Spark DataFrame jobs."""
