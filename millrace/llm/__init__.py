"""Operators for large-scale training-data preparation.

Nothing outside this package imports it; ``__spark_entry__`` picks its queries up when it is present.
"""
