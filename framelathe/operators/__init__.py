"""Relational operators on frames, verdicts, catalogs and budgets."""
