"""Operators of a training-data pipeline, their queries and SQL."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
