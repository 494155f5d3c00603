"""Column functions: numbers, text, images, tokens."""
