"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage. Each module holds one operator with a general
interface; ``queries`` holds the registered queries that apply them to whole tables.
"""
