"""Trajectory and flight-operations analytics on Spark DataFrames."""
