"""Relational operators on postings."""
