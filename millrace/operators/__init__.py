"""Operators over DataFrames of the envelope schema."""
