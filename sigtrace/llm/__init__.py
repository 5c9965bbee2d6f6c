"""Operators for preparing training text at scale, one module per operator.

Nothing else in the package imports this subpackage.  ``queries.py`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
