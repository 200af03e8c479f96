"""Operators for preparing training corpora: dedup, mixing, packing, filtering.

Nothing outside this subpackage imports it.
"""
