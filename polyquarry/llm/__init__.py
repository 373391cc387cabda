"""Training-data operators: sharding, mixing, filtering, search, dedup, packing, media, language and licence work.

Nothing outside this subpackage imports it.
"""
