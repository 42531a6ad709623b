"""Relational and discovery operators over DataFrames."""
