"""Player-impact analytics as Spark DataFrame jobs."""
