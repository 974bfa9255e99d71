"""Resistance analytics as Spark DataFrame plans."""
