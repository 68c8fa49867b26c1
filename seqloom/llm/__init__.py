"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own; :mod:`seqloom.llm.queries` registers one query for each.
"""
