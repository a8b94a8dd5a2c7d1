"""Operators for preparing training corpora, each with the query that applies it."""
