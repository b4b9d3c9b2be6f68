"""Operators for large-scale training-text preparation.

Nothing else in the library imports this subpackage. Each module holds one operator with its own
general interface; ``queries`` registers the production queries and ``oracles`` their SQL.
"""
