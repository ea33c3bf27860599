"""Behavioural early-warning analytics expressed as Spark DataFrame jobs."""
