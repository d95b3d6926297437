"""Column expressions: URLs and texts; and the HTML helper."""
