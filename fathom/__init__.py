"""Operators for archives, pitch series, search, vectors and keyed state on PySpark."""
