"""Catalogue quality engine on PySpark: profiling, screening, deltas, datasets."""
