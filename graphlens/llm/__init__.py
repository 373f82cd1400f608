"""Operators of a training-data pipeline, one module each, over plain DataFrames."""
