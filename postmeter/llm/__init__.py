"""Operators for large text corpora: deduplication, search, tokens, packing.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; each operator has a module of its own.
"""
