"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
