"""Operators: DataFrame(s) in, DataFrame out, nothing executed."""
