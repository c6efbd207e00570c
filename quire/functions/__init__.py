"""Column functions and vectorised Python functions."""
