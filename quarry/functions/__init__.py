"""Column expressions: paths, lines, vectors and links. No function here runs Python per row."""
