"""Training-data operators: quality, toxicity, language, near duplicates, extraction, packing, sharding.

Each module holds one operator with a general interface (any id and text column); ``queries.py``
holds the thin registered queries. Nothing outside this package imports it.
"""
