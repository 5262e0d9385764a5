"""Operators that prepare large training corpora.

Nothing outside this package imports it; it may use the rest of the library.
"""
