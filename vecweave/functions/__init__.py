"""Column functions: vectors and sorted vertex sets."""
