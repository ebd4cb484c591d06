"""Operators for preparing large text corpora (deduplication, filtering, tokenizing).

Nothing outside this subpackage imports it; it imports nothing outside itself.
"""
