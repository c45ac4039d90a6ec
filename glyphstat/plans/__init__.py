"""Registered queries: operators bound to the given tables."""
