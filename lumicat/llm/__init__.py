"""Operators for training-data pipelines: quality, derivatives, extraction, joins, deduplication, decontamination, encoding."""
