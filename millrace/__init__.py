"""Commerce metrics and document analytics as Spark DataFrame jobs."""
