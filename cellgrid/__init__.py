"""Spreadsheet-shaped relational analytics on Spark: cells, references, revisions and certificates as DataFrames."""
