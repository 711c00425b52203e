"""Loomspan: a corpus analytics engine built on Spark DataFrames."""
