"""Column functions: gains, vectors, text and statistics."""
