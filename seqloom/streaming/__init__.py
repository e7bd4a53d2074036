"""Streaming k-mer counts."""
