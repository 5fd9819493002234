"""DataFrame operators: they take DataFrames and column names and return DataFrames."""
