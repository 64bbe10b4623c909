"""Ready-made queries over the given tables."""
