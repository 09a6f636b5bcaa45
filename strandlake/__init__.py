"""Spark-native analytics for nucleotide-encoded data archives."""
