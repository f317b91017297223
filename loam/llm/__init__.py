"""Operators of a training-data pipeline; nothing else in ``loam`` imports this."""
