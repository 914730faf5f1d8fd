"""Corpus operators for training-data pipelines.  Nothing else in the library uses them."""
