"""Sources of the analytics library."""
