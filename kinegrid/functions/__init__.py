"""Column functions: missing values, statistics, geometry."""
