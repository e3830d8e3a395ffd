"""Column functions: text, and the phonetic codes."""
