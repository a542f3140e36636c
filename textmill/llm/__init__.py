"""Operators for large training-data pipelines; nothing else in textmill imports this subpackage."""
