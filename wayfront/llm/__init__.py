"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries and their SQL; each other module holds one operator.
"""
