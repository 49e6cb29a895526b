"""Readers that turn file trees into DataFrames."""
