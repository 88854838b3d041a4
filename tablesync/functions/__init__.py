"""Column expressions: names, JSON codec, cursors, digests."""
