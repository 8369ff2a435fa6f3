"""Operators of a training-data pipeline: language id, toxicity, quality,
near-duplicates, packing, exact search and mixing. Nothing else in the library
imports this subpackage."""
