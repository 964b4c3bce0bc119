"""Paired evaluation of text generators and scorers on Spark DataFrames."""
