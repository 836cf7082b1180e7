"""Corpus, retrieval and evaluation analytics for multilingual text, on Spark DataFrames."""
