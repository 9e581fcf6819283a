"""Column functions: vectors and labels."""
