"""Operators for training-data pipelines: filters, near-duplicates, packing, archives and token files."""
