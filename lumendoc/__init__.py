"""Corpus-scale document remediation and analytics on Spark DataFrames."""
