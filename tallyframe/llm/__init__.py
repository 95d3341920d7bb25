"""Operators of a training-data pipeline (fingerprints, deduplication,
scoring, mixing, packing, token files).  Nothing else in the library imports
this subpackage."""
