"""Operators for preparing training data: selection, duplicates, privacy, tokens, search."""
