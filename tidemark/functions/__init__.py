"""Functions of single values."""
