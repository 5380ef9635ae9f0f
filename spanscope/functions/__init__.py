"""Column functions: hashed draws, codecs, metrics."""
