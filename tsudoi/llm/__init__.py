"""Operators for large training corpora. Nothing outside this package and ``corpus_pipeline.py`` imports it."""
