"""Column functions: paths, text, vectors and display formatting."""
