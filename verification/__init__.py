"""Fixtures, registered queries and their SQL counterparts."""
