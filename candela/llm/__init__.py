"""Operators for training-data pipelines: text quality, dedup, mixing, tokenising, search.

Nothing outside this subpackage imports it.
"""
