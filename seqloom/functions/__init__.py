"""Column functions over sequences."""
