"""Relational operators that Spark doesn't have in the form asked for."""
