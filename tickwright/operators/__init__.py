"""Table operators: every function takes and returns DataFrames over all symbols at once."""
