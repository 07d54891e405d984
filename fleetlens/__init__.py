"""Device-traffic anomaly analytics expressed as Spark DataFrame jobs."""
