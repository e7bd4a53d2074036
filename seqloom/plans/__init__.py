"""Plan building blocks that hold at scale, and the persisted index."""
