"""Scalar functions: IEEE-754 semantics, the formula language and its catalogue."""
