"""What a job drops, counted while it runs.

A step's counts are observed on the rows that pass it, so they come with the job itself: no row is read twice. The step is
a barrier to the optimiser in exchange: the condition is tested where the step stands and not in the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import is_missing
from .filters import drop_incomplete


class Accounts:
    """Counts by step: ``rows`` that came, ``dropped`` ones, and for the columns asked for ``missing_<column>``.

    Counts are those of the first action that runs the step. A frame that is read in two places of a plan is run twice and would be
    counted twice; write it first."""

    def __init__(self) -> None:
        self._seen: dict[str, tuple[Observation, Observation]] = {}

    def through(
        self, df: DataFrame, step: str, operator: Callable[[DataFrame], DataFrame], missing: Sequence[str] = ()
    ) -> DataFrame:
        """``operator(df)``, rows counted before and after it."""
        if step in self._seen:
            raise ValueError(f"two steps named {step}")
        self._seen[step] = before, after = Observation(f"{step}: before"), Observation(f"{step}: after")
        gaps = [F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"missing_{c}") for c in missing]
        rows = F.count(F.lit(1))
        return operator(df.observe(before, rows.alias("rows"), *gaps)).observe(after, rows.alias("left"))

    def keep(self, df: DataFrame, step: str, condition: Column, missing: Sequence[str] = ()) -> DataFrame:
        """Rows for which ``condition`` holds; others, also where it is NULL, are dropped and counted."""
        return self.through(df, step, lambda rows: rows.filter(condition), missing)

    def keep_complete(self, df: DataFrame, step: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows that have a value in all of ``columns`` (all there are, where not given), and how often each has none."""
        names = list(columns or df.columns)
        return self.through(df, step, lambda rows: drop_incomplete(rows, names), names)

    def counts(self) -> dict[str, dict[str, int]]:
        """By step; waits for the action that runs it."""
        out = {}
        for step, (before, after) in self._seen.items():
            own = dict(before.get)
            out[step] = {"rows": own.pop("rows"), "dropped": before.get["rows"] - after.get["left"], **own}
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, measure, value) of all steps, a row for each: as many as a job has steps and columns."""
        rows = [(step, measure, value) for step, own in self.counts().items() for measure, value in own.items()]
        return spark.createDataFrame(rows, "step string, measure string, value bigint")


class NoAccounts(Accounts):
    """Filters as ever, nothing counted: conditions reach the scan."""

    def through(
        self, df: DataFrame, step: str, operator: Callable[[DataFrame], DataFrame], missing: Sequence[str] = ()
    ) -> DataFrame:
        return operator(df)
