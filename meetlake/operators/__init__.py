"""Table-level operators: every public function maps DataFrames to a DataFrame."""
