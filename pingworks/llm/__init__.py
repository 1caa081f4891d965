"""Operators of a training-data pipeline: mixing, packing, classification, scans,
archives, near-duplicate joins, token stores, media columns, token counts and
quality rules.  Nothing outside this folder imports it."""
