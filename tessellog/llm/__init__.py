"""Operators for preparing training text at scale.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface; ``queries.py`` derives the registered queries.
"""
