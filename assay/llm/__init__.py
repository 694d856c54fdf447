"""Operators for preparing training data: text, embedding, URL and packing jobs."""
