"""Readers: paths, documents and catalog tables to DataFrames."""
