"""Training-data operators on Spark: tokens, quality, packing, near-duplicates, record files, vector search, secrets.

Each module holds one operator with its own general interface; ``queries`` registers the thin ``opN_*`` queries.
"""
