"""Training-data operators: quality, language, toxicity, packing, HTML, dedup, mixing, sharding, media, joins.

Nothing outside this subpackage imports it.
"""
