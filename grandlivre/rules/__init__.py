"""Rule tables of the accounting operators, as constants and as small DataFrames."""
