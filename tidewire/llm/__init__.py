"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries only when the package is present.
"""
