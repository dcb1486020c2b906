"""Training-data operators: extraction, search, packing, deduplication, filtering, mixing and scoring.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries.
"""
