"""Document-revision analytics as Spark DataFrame jobs."""
