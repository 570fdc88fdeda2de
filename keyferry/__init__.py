"""keyferry: keyspace migration and reconciliation as Spark DataFrame jobs."""
