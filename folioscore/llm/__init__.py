"""Operators of a large-scale training-text pipeline; nothing else in the library imports this subpackage."""
