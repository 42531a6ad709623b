"""Types, references, formulas and other scalar rules."""
