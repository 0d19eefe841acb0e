"""Views as plain descriptions, and the DataFrames they stand for."""
