"""Media provenance analytics as Spark DataFrame jobs."""
