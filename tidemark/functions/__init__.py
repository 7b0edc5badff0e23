"""Column-level building blocks; every one is a built-in expression."""
