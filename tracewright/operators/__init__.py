"""Operators over samples and frames, each a composition of DataFrame operations."""
