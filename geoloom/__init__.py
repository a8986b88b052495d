"""Geospatial feature analytics as Spark DataFrame jobs."""
