"""DataFrame operators: all are functions from DataFrames to DataFrames."""
