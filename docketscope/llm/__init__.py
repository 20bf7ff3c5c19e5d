"""Operators for preparing training data: one module per operator, ``queries`` registers them.

Each operator takes and returns DataFrames, names the columns it reads, ignores
every other column of its input, and runs its per-text work in Arrow batches.
"""
