"""Operators for large-scale training-data pipelines, as Spark jobs.

Nothing outside this subpackage imports it.
"""
