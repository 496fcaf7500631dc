"""Operators for preparing training text at corpus scale.

Every module holds one operator with a general interface; ``queries.py`` derives the registered ``opN_*`` results.
Nothing outside this subpackage imports it.
"""
