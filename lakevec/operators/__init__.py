"""Data-processing operators; each takes and returns DataFrames."""
