"""Corpus operators: training-data preparation on whole tables."""
