"""Sparse-code analytics on PySpark: encode, compare, lay out, activate, decode."""
