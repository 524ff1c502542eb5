"""Operators for training-data work on vectors, groups and texts."""
