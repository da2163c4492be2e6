"""Column functions and small DataFrame transforms on text, markup and numbers."""
