"""Column functions that normalise log values."""
