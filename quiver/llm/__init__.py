"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; ``queries.py`` lists the
registered queries and ``corpus_pipeline.py`` chains five of the operators.
"""
