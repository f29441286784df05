"""Column-level building blocks: every helper maps columns to a column."""
