"""Tabular profiling, association, regression and scenario scoring on Spark DataFrames."""
