"""Operators of a training-data pipeline; nothing else in this library imports them."""
