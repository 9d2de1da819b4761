"""plotlink: burial-record linkage and grave location as Spark DataFrame jobs."""
