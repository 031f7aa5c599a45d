"""Scalar functions and extension types as builders of columns."""
