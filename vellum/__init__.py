"""Vellum: layout-aware document text analytics on Spark DataFrames."""
