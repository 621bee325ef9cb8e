"""Corpus operators: DataFrame in, lazy DataFrame out."""
