"""Detection and inspection analytics as Spark DataFrame jobs."""
