"""Operators for preparing language-model training data.

Nothing else in the library imports this package.  Each module holds one
operator with its own general interface; ``registry`` holds the thin queries
``opN_<name>`` over them and their oracle SQL.
"""
