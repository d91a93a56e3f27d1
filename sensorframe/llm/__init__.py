"""Operators for text corpora: deduplication, extraction, formatting, tokenizing, packing, filtering, scanning.

Nothing outside this package imports it.
"""
