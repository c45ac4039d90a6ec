"""Operators for preparing training data: deduplication, filters, mixing, search and tokenizing."""
