"""Conservation observed in passing: a build's own jobs count what goes in and out, no scan is added."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import Observation


class NotConserved(RuntimeError):
    """Rows or totals were lost or made on the way."""


class Audit:
    """Named observation points of one build.

    ``watch`` puts a point into a frame's plan; the values are there once an action
    has run the plan. ``check`` compares sums of two points.
    """

    def __init__(self) -> None:
        self.points: dict[str, Observation] = {}

    def watch(self, df: DataFrame, point: str, **metrics: Column) -> DataFrame:
        self.points[point] = Observation(point)
        return df.observe(self.points[point], *(c.alias(name) for name, c in metrics.items()))

    def values(self, point: str) -> dict[str, int]:
        """Waits for the action that runs the point's plan."""
        return {k: int(v or 0) for k, v in self.points[point].get.items()}

    def check(self, what: str, into: int, out: int) -> None:
        if into != out:
            raise NotConserved(f"{what}: {into} in, {out} out")
