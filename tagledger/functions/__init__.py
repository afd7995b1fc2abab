"""Column builders: no joins, no actions."""
