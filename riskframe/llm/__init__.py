"""Operators for building training data from web-scale text.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
