"""Column builders.  They return expressions and never touch data."""
