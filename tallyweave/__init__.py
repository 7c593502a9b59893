"""Survey analytics as Spark DataFrame jobs, keyed by survey."""
