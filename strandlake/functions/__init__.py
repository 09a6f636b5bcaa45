"""Column functions: conversions, strand rules, field arithmetic, counter-based randomness."""
