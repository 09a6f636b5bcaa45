"""Queries over the sample tables, one module a family; each has ``QUERIES`` and ``ORACLES``."""
