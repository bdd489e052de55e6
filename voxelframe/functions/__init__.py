"""Column expressions: names and paths, shapes and chunks."""
