"""Readers of workbooks and tables."""
