"""Column functions: text, identity, budgets, vectors."""
