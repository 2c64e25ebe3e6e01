"""Column expressions: digests, paths, names, scalars."""
