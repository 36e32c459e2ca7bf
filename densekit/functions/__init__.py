"""Column functions: vectors, pooling, hashing."""
