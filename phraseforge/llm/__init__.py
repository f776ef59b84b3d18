"""Operators for preparing training text: ten operators and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
