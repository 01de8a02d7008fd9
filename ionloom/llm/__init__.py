"""Training-data operators: extraction, quality, filtering, search, dedup, language, tokens, shards, mixing, PII.

Nothing outside this package imports it.
"""
