"""Column expressions: no DataFrame, no action, no UDF."""
