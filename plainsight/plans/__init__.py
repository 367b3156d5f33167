"""The analyses, one module per study, as functions from DataFrames to DataFrames."""
