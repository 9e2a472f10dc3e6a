"""Operators for training-data pipelines: scoring, de-duplication, mixing and token output.

Each operator takes DataFrames with any columns and names the columns it reads. It
selects those at once, so that other columns, whatever their names, neither clash
nor travel. Nothing else in the library imports this subpackage.
"""
