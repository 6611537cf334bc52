"""Column functions and rule vocabularies."""
