"""Operators that prepare a corpus for language-model training.

Nothing outside this subpackage imports it, besides the query catalogue's guard.
"""
