"""Column expressions: hashing, text, keys, signing, geometry, vectors, cursors."""
