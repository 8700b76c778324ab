"""Training-data operators: classification, search, deduplication, archives, packing and token counts.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered queries; each
operator module holds the general operator the query is a thin digest of.
"""
