"""Readers of recordings, databases and configuration files."""
