"""Column expressions: bit sets, feature structures, strings."""
