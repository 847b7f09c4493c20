"""Document retrieval and evidence analytics as Spark DataFrame jobs."""
