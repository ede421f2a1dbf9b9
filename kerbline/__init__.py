"""Street-disruption analytics expressed as ordinary Spark DataFrame jobs."""
