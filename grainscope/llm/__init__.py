"""Operators for preparing training data: encoding, packing, deduplication, search, language and secret detection."""
