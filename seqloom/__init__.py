"""Exact sequence alignment over DataFrames of sequence pairs."""
