"""Labelled-array analytics on Spark: binning, grouping, reductions, lookups and unit-checked algebra over DataFrames."""
