"""Operators for training-data corpora: cleaning, deduplication, formatting, tokens.

Nothing else in the library imports this subpackage.
"""
