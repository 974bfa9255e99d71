"""Column functions: names, statistics, argument checks."""
