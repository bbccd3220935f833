"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface, and ``queries`` the thin queries over them.
"""
