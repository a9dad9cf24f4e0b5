"""Operators of a training-data pipeline over documents, built on Spark."""
