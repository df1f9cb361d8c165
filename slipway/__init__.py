"""Data-readiness, SLA and drift analytics as Spark DataFrame jobs."""
