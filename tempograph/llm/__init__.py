"""Operators for preparing training text at corpus scale.

Each module holds one operator with a general DataFrame interface; ``queries``
holds the thin registered queries.  Nothing outside this package imports it.
"""
