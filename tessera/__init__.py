"""Tessera: a Spark-native engine for document provenance graphs.

Chunks, terms, concepts and facts are DataFrames; every operator is a function
from DataFrames to a DataFrame.
"""
