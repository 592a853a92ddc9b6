"""Operators of a training-data pipeline: search, packing, joins, fingerprints, filters, tokens and chats."""
