"""Edits of single cells that leave the rest of a workbook's bytes as they are; serial work on one file."""
