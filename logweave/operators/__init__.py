"""Operators on DataFrames: lines, search, replacement, traces and data flow."""
