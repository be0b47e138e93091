"""Millrace: corpus curation, evaluation metrics and evidence analytics on Spark DataFrames."""
