"""Operators on lines, postings and matches."""
