"""Operators of a training-data pipeline; nothing outside this folder imports them."""
