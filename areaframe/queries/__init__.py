"""Every operator bound to the given tables, with an oracle where SQL can say it."""

from . import cleaning, grouped, jobs, records, scoring
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "grouped", "jobs", "records", "scoring"]
