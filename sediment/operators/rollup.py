"""Daily rollups: build, refresh the days that changed, and answer a query from one if it can."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions import sketches
from sediment.operators.aggregates import merge_states
from sediment.sources.day_table import DayTable

#: Standard error of a sketch of 2^14 registers, as a share.
SKETCH_ERROR = 1.04 / 2**7
ROLLUP_SCHEMA = (
    "event_date DATE, event_type STRING, event_count BIGINT, unique_users BIGINT, users BINARY"
)


def daily_rollup(events: DataFrame, dims: Sequence[str] = ("event_date",)) -> DataFrame:
    """Events and distinct users per day (and further dimensions)."""
    return events.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("event_count"), F.count_distinct("user_id").alias("unique_users")
    )


def rollup_with_sketch(events: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The rollup with a user sketch, so that coarser groups can estimate distinct users."""
    return events.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("user_id").alias("unique_users"),
        sketches.user_sketch(F.col("user_id"), 14).alias("users"),
    )


def refresh_rollup(rollup: DayTable, base: DayTable, days: Iterable[str]) -> None:
    """Recompute the named days; distinct counts of a day cannot be added up from parts."""
    days = sorted(set(days))
    fresh = rollup_with_sketch(base.read(days), ["event_date", "event_type"])
    rollup.rewrite(lambda _old: fresh, set(days))


def add_states(
    table: DayTable, new: DataFrame, dims: Sequence[str], token: tuple[str, int] | None = None
) -> list[str]:
    """Merge new aggregate states into a stored table of states; only their days are rewritten."""
    touched = table.days_of(new)
    table.rewrite(lambda old: merge_states(old, new, dims), touched, token)
    return sorted(touched)


def users_from_sketches(rollup: DataFrame, dims: Sequence[str], sketch: str = "users") -> DataFrame:
    """``event_count, approx_users`` per ``dims``, coarser than the rollup, from its stored sketches alone."""
    return rollup.groupBy(*dims).agg(
        F.sum("event_count").alias("event_count"),
        sketches.sketch_count(sketches.sketch_union(F.col(sketch))).alias("approx_users"),
    )


class RollupRouter:
    """Reads the rollup when it covers the question, else the base table.

    Counts add up over any subset of the rollup's dimensions. Exact distinct users are stored for the
    rollup's own grain only; at another grain the base is read. ``approx_users`` is estimated from the
    stored sketches at every grain that the rollup covers, with a standard error of ``SKETCH_ERROR``.
    """

    def __init__(self, base: DataFrame, rollup: DataFrame, grain: Sequence[str]):
        self.base, self.rollup, self.grain = base, rollup, list(grain)

    def covers(self, dims: Sequence[str], measures: Sequence[str]) -> bool:
        if not set(dims) <= set(self.grain):
            return False
        if "approx_users" in measures and "users" not in self.rollup.columns:
            return False
        return set(measures) <= {"event_count", "approx_users"} or (
            set(measures) <= {"event_count", "unique_users"} and set(dims) == set(self.grain)
        )

    def answer(self, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
        if not self.covers(dims, measures):
            exact = daily_rollup(self.base, dims).withColumn("approx_users", F.col("unique_users"))
            return exact.select(*dims, *measures)
        if "approx_users" in measures:
            return users_from_sketches(self.rollup, dims).select(*dims, *measures)
        if set(dims) == set(self.grain):
            return self.rollup.select(*dims, *measures)
        summed = self.rollup.groupBy(*dims).agg(F.sum("event_count").alias("event_count"))
        return summed.select(*dims, *measures)
