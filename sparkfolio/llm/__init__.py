"""Training-data operators: sharding, search, dedup, extraction, encoding and mixing.

Nothing outside this subpackage imports it, save the guarded hook in ``__spark_entry__``.
"""
