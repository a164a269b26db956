"""Operators for training-data pipelines over a ``documents`` table.

One module per operator, each with its own general interface; ``queries.py``
registers a thin digest query for every one of them.  Nothing outside this
subpackage imports it.
"""
