"""Operators for preparing training corpora at cluster scale.

Nothing outside this subpackage imports it; `queries.py` holds the registered
queries, and `corpus_pipeline.py` at the top of the repository chains five of
the operators.
"""
