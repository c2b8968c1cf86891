"""Customer-feedback analytics as Spark jobs."""
