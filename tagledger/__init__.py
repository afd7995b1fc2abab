"""Cost attribution on Spark: find spend that lacks the chosen chargeback tag
keys, propose values for it, and apply, audit and undo the resulting changes.

Every operator is a function from DataFrames to a DataFrame. Clocks, ids and
run tokens are arguments, so a plan gives the same result each time it runs.
"""
