"""Operators for preparing training data at scale.

Each module holds one operator with a general interface; ``queries`` derives the
registered queries from them. Nothing else in the library imports this package.
"""
