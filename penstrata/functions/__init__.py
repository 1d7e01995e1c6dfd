"""Part of penstrata."""
