"""Operators over predictions, importances and results."""
