"""Gleanery: web-page extraction, ranking and content storage as Spark jobs."""
