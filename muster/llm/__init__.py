"""Operators of a training-data pipeline: one module per operator, bound to the tables in ``queries``."""
