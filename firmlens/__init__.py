"""Turns fetched web pages and returned payloads into a clean catalogue of organisations, as Spark jobs."""
