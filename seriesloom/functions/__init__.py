"""Column expressions that need no window and no grouping."""
