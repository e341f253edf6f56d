"""Stored indexes: positional postings, vectors in inverted lists, trigram postings."""
