"""Batch jobs over human-mobility trajectories on Spark: DataFrames in, DataFrames out."""
