"""Operators for preparing large text corpora: filtering, deduplication, mixing, formatting and encoding."""
