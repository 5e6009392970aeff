"""Lexiflume: retrieval, evaluation and corpus operators on Spark DataFrames."""
