"""Batch and streaming Spark jobs over paginated research reports."""
