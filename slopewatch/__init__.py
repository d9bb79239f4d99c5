"""Natural-hazard analytics as Spark DataFrame jobs."""
