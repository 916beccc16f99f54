"""Training-data operators: mixing, search, deduplication, archives, sharding, packing and filtering.

Nothing outside this subpackage imports it.
"""
