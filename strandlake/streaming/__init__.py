"""Reads as they arrive."""
