"""Feedback analytics on Spark: every operator takes DataFrames and returns one."""
