"""Table-level stages, each a function from DataFrame to DataFrame."""
