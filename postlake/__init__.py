"""Spark jobs that turn captured career pages into a deduplicated table of matching postings."""
