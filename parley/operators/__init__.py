"""Operators: each takes and returns DataFrames; none triggers a job unless its docstring says so."""
