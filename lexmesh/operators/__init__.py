"""Operators over DataFrames.

Note on ``explode_outer``: for a plain ``explode`` of a costly expression Catalyst
adds a non-empty filter in front, which would evaluate the expression twice (and
before a shuffle, once on each side). The outer form plus a null filter on the
result evaluates it once.
"""
