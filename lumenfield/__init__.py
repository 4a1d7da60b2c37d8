"""Imaging-survey analytics on Spark DataFrames."""
