"""Column functions: fingerprints and the algebra of binary vectors, dense-vector measures."""
