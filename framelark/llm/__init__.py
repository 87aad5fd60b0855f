"""Operators for preparing training text, their queries and SQL twins."""
