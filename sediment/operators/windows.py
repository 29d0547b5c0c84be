"""Row-order functions that do not put a hot key into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Keys with too many rows for
that are found by one aggregate, and their rows are scanned in two passes by rank: they are
range-partitioned on key, order and ties, so that even rows of one moment are cut; each range is reduced
to one summary per key; a prefix over the summaries gives what a range inherits; and the value within
the range is added to that. All other keys go through the plain window, shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sediment.operators.joins import hot_keys
from sediment.session import scratch_path


def split_hot(rows: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of all other keys, rows of keys with too many rows for one task or None)."""
    hot = hot_keys(rows, key, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), nulls=True)
    if hot is None:
        return rows, None
    few = F.broadcast(hot.withColumnsRenamed({k: f"_hot_{k}" for k in key}))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in key]
    return rows.join(few, same, "left_anti"), rows.join(few, same, "left_semi")


def ranges_of(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_range``: consecutive numbers of consecutive runs of rows in the order of key and order.

    The runs hold about as many rows each, whatever the keys; ``order`` should be unique within a key,
    as equal rows stay together. Written to the shared folder, so that all later steps see the same runs.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "ranges")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *key, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def inherited(ranges: DataFrame, key: Sequence[str], summary: Column, before: Column) -> DataFrame:
    """``_key…, _of, _carry``: what each range of a key inherits from its earlier ranges.

    ``summary`` reduces a range to one value, ``before`` is a function over the summaries ``_summary`` of
    the earlier ranges. One row per range and hot key in it.
    """
    across = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*key, "_range").agg(summary.alias("_summary"))
    names = [F.col(k).alias(f"_key_{k}") for k in key]
    return totals.select(*names, F.col("_range").alias("_of"), before.over(across).alias("_carry"))


def _scan(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], name: str, summary: Column, before: Column, value
) -> DataFrame:
    """``value(window, carry)`` as column ``name``: over plain windows, and over ranges for hot keys.

    ``carry`` is null where nothing is inherited.
    """
    cold, hot = split_hot(rows, key)
    none = F.lit(None).cast(rows.select(summary).schema[0].dataType)
    plain = cold.withColumn(name, value(Window.partitionBy(*key).orderBy(*order), none))
    if hot is None:
        return plain
    ranges = ranges_of(hot, key, order)
    # At most as many rows as there are ranges and hot keys; both are bounded by the number of tasks.
    carried = F.broadcast(inherited(ranges, key, summary, before))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key]
    marked = ranges.join(carried, [*same, F.col("_range") == F.col("_of")])
    inside = Window.partitionBy("_range", *key).orderBy(*order)
    scanned = marked.withColumn(name, value(inside, F.col("_carry")))
    return plain.unionByName(scanned.select(*plain.columns))


def running_total(rows: DataFrame, key: Sequence[str], at: str, ties: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` from the key's first row to this one, in the order ``at, ties``."""
    kind = rows.select(F.sum(value)).schema[0].dataType

    def total(window: WindowSpec, carry: Column) -> Column:
        own = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
        return F.coalesce(own + carry, own, carry).cast(kind)

    return _scan(rows, key, [at, *ties], name, F.sum(value), F.sum("_summary"), total)


def difference_to_previous(
    rows: DataFrame, key: Sequence[str], at: str, ties: Sequence[str], value: str, name: str
) -> DataFrame:
    """``value`` minus the value of the key's previous row; 0 for the first row."""
    last = F.max_by(F.col(value), F.struct(at, *ties))
    kind = rows.schema[value].dataType

    def difference(window: WindowSpec, carry: Column) -> Column:
        first = F.row_number().over(window) == 1
        previous = F.when(first, carry.cast(kind)).otherwise(F.lag(value).over(window))
        return F.coalesce(F.col(value) - previous, F.lit(0))

    return _scan(rows, key, [at, *ties], name, last, F.last("_summary"), difference)


def job_alerts(checks: DataFrame, wanted_tasks: Column | int) -> DataFrame:
    """Level per job check: ``page`` when paused, ``warn`` when errors grew at two checks in a row,
    ``info`` when fewer tasks run than wanted, else ``ok``. One row per job and check comes in."""
    order = Window.partitionBy("job_name").orderBy("checked_at")
    one, two = F.lag("error_rows", 1).over(order), F.lag("error_rows", 2).over(order)
    grew = (F.col("error_rows") > one) & (one > two)
    wanted = F.lit(wanted_tasks) if isinstance(wanted_tasks, int) else wanted_tasks
    level = (
        F.when(F.col("state") == "PAUSED", "page")
        .when(grew, "warn")
        .when(F.col("current_tasks") < wanted, "info")
        .otherwise("ok")
    )
    return checks.withColumn("alert", level)
