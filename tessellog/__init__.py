"""Tessellog: a Spark-native engine over logs of collaborative text edits.

A document is a *set* of content-addressed operations.  Every operator takes
and returns DataFrames keyed by ``doc_id``, so plain Spark SQL composes on top.
"""

__version__ = "0.1.0"
