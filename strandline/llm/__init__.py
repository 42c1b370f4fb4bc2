"""Training-data operators: filters, deduplication, scoring, sharding and packing.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin
``opN_*`` queries, every other module one operator with its own interface.
"""
