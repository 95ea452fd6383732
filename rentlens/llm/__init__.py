"""Operators for preparing training data: duplicates, quality, search, tokens, languages, personal data."""
