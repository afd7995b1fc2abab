"""Stored tables."""
