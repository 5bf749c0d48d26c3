"""Operators for large-scale training-data preparation.

Every module holds one operator with its own general interface; ``queries`` holds the thin registered
queries. Nothing outside this subpackage (and ``corpus_pipeline.py``, which belongs to it) imports it.
"""
