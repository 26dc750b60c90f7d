"""Semantic-model measure and validation engine on Spark DataFrames."""

__version__ = "0.1.0"
