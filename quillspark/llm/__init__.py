"""Training-data operators: scoring, linking, deduplication, extraction, filtering, packing and search.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries and their SQL.
"""
