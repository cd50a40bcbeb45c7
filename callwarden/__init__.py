"""Privacy audit of captured mobile API calls, expressed as Spark DataFrame jobs."""
