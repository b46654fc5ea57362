"""Training-data operators: near-duplicates, chat formatting, search, packing,
filtering, sharding, tokenising, redaction and scoring.

Nothing outside this subpackage imports it.
"""
