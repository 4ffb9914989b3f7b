"""Audience, revenue and donor analytics for ticketed events, as Spark DataFrame jobs."""
