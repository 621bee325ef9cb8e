"""Column functions: text, draws, codecs, n-grams, formatting."""
