"""Operators for large training corpora.

The package stands alone: nothing else in the library imports it.
"""
