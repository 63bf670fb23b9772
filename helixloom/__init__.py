"""Annotated genome variants and family cohorts as plain PySpark DataFrames."""
