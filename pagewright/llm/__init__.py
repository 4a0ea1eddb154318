"""Operators for large training corpora; nothing else in the library imports this package.

``queries.load()`` gives the registered queries ``opN_<name>`` and their DuckDB twins.
"""
