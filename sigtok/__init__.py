"""sigtok: tokenizing long one-dimensional signals, and analysing the result, on Spark DataFrames."""

__version__ = "0.1.0"
