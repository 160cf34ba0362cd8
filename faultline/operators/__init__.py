"""Relational operators of retrieval and of the diagnosis graph."""
