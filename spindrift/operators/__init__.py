"""Operators over corpora, indexes, rankings, budgets, decisions and registers."""
