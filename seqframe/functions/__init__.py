"""Scalar functions, function objects, and random numbers."""
