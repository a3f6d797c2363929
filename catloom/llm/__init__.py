"""Operators of a training-data pipeline over documents; nothing else in the library imports this package."""
