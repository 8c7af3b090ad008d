"""Operators for preparing training text: deduplication, language, markup, privacy, packing, mixing, quality and sharding."""
