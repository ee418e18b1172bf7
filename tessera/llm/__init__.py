"""Operators of a training-data pipeline over whole text collections.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries that apply them to whole tables.
Nothing outside this subpackage imports it.
"""
