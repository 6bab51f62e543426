"""Functions of the analytics library."""
