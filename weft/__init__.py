"""Hypergraph analytics, search, rules and belief tables on Spark DataFrames."""
