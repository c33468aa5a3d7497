"""Operators for preparing training corpora: quality rules, deduplication, search, archives,
classification, personal data, tokenising and mixing. Nothing outside this package imports it."""
