"""Column functions: text, vectors, grounding words."""
