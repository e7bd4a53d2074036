"""Operators over sequences: k-mers, coordinates, profiles, patterns, rank and select, suffix order."""
