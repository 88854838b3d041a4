"""Operators of a training-data pipeline: filters, joins, scans, deduplication, packing, scoring."""
