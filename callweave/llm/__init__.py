"""Operators that prepare transcripts and web captures as training data.

Nothing else in the library imports this package.
"""
