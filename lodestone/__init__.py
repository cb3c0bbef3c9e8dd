"""Lodestone: a retrieval analytics engine on Spark DataFrames."""
