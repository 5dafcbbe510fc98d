"""Scalar functions of the language as Catalyst expressions."""
