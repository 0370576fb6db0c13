"""Plumbline: calibration analytics on Spark DataFrames."""
