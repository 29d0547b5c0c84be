"""Queries over deduplication, layout and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators import aggregates, dedup, joins, layout, retention
from sediment.plans import inputs
from sediment.plans.registry import query
from sediment.session import scratch_path
from sediment.sources.day_table import DayTable

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_TIES = (
    "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
)
STORED = "event_id BIGINT, user_id BIGINT, event_date DATE, eviction_date DATE, cents BIGINT"


def stored_columns(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("event_id", "user_id", "event_date", "eviction_date", "cents", *more)


def by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("total_cents")
    )


def _latest_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = inputs.table(spark, folder, "lineitem")
    return dedup.keep_latest_version(lines, LINE_KEY, "l_shipdate", LINE_TIES)


@query
def dedup_latest_version(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate")
    latest = _latest_lines(spark, folder)
    number = F.col("l_linenumber").cast("bigint").alias("l_linenumber")
    return latest.select("l_orderkey", number, day, *LINE_TIES)


@query
def final_read_agg(spark: SparkSession, folder: str) -> DataFrame:
    return _latest_lines(spark, folder).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"),
    )


@query
def upsert_events(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    late = inputs.replays(events).unionByName(
        inputs.replays(events, moved=True).withColumn("_seq", F.col("_seq") + 1)
    )
    current = dedup.upsert_rows(events, late, ["event_id"], ["_seq"])
    return current.select("event_id", F.col("event_date").cast("string").alias("event_date"), "cents")


@query
def day_table_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The upsert through the stored table: appended as a delta, read, merged, read again."""
    events = inputs.canonical_events(spark, folder)
    table = DayTable(spark, scratch_path(spark, "upsert"), STORED, ["event_id"], sort=["user_id"], mode="read")
    table.append(stored_columns(events))
    table.upsert(stored_columns(inputs.replays(events, moved=True), "_seq"), ["_seq"])
    before = by_day(table.read())
    table.fold()
    after = by_day(table.read()).select(
        "event_date", F.col("n_rows").alias("rows_merged"), F.col("total_cents").alias("cents_merged")
    )
    return before.join(after, "event_date", "full_outer")


@query
def duplicate_rate_by_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.events_with_replays(inputs.canonical_events(spark, folder))
    rate = dedup.duplicate_rate(rows, ["event_date"], ["event_id"])
    return rate.withColumn("event_date", F.col("event_date").cast("string"))


@query
def batch_ledger_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every hourly batch is delivered again, some twice; the ledger holds the last 120 up to ``AS_OF``."""
    return _accepted_batches(spark, folder, last=120)


@query
def batch_ledger_by_time(spark: SparkSession, folder: str) -> DataFrame:
    """The same with all batches of the last seven days in the ledger, as the ingest job has them."""
    return _accepted_batches(spark, folder, last=None)


def _accepted_batches(spark: SparkSession, folder: str, last: int | None) -> DataFrame:
    rows = inputs.canonical_events(spark, folder).withColumn("batch_hour", F.date_trunc("hour", "ts"))
    prints = dedup.batch_fingerprints(rows, ["batch_hour"], ["event_id", "user_id", "event_type", "cents"])
    ledger = prints.withColumn("accepted_at", F.col("batch_hour"))
    live = dedup.live_ledger(ledger, F.lit(inputs.AS_OF).cast("timestamp"), last=last, days=7)
    again = prints.withColumn("arrival", F.lit(1)).unionByName(
        prints.where(F.hour("batch_hour") % 7 == 0).withColumn("arrival", F.lit(2))
    )
    accepted = dedup.unseen_batches(again, live, ["arrival"])
    return accepted.select(
        F.date_format("batch_hour", "yyyy-MM-dd HH").alias("batch_hour"),
        F.col("arrival").cast("bigint").alias("arrival"),
        "batch_rows",
    )


@query
def merge_aggregate_states(spark: SparkSession, folder: str) -> DataFrame:
    """States of two deliveries merged, checked against the exact number of users."""
    events = inputs.canonical_events(spark, folder).withColumn("day", F.col("event_date").cast("string"))
    dims = ["day", "event_type"]
    halves = [
        aggregates.aggregate_states(events.where(f"event_id % 2 = {h}"), dims, F.col("cents"), "user_id")
        for h in (0, 1)
    ]
    merged = aggregates.read_states(aggregates.merge_states(*halves, dims), dims)
    exact = events.groupBy(*dims).agg(F.count_distinct("user_id").alias("exact"))
    close = F.abs(F.col("users") - F.col("exact")) <= F.col("exact") * 0.05
    return merged.join(exact, dims).select(*dims, "n", "total", "low", "high", close.alias("users_close"))


@query
def rows_per_partition(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    days = layout.rows_per_partition(events, F.col("event_date").cast("string"))
    months = layout.rows_per_partition(events, F.date_format("event_date", "yyyyMM"))
    return days.unionByName(months)


@query
def bucket_skew(spark: SparkSession, folder: str) -> DataFrame:
    skew = layout.bucket_skew(inputs.table(spark, folder, "events"), "event_id")
    return skew.select("total_rows", "used_buckets", (F.col("max_over_avg") < 2).alias("even"))


@query
def partition_calendar(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    calendar = layout.partition_calendar(events, "event_date", inputs.AS_OF)
    return calendar.withColumn("event_date", F.col("event_date").cast("string"))


@query
def rows_outside_window(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    outside = events.where(layout.outside_window(F.col("event_date"), inputs.AS_OF))
    return outside.select("event_id", F.col("event_date").cast("string").alias("event_date"))


@query
def expired_partitions(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    # Days up to the 12th get eviction dates within nine days, so some days have expired as a whole.
    early = F.least("eviction_date", F.date_add("event_date", 9))
    rows = events.withColumn(
        "eviction_date", F.when(F.dayofmonth("event_date") <= 12, early).otherwise(F.col("eviction_date"))
    )
    both = None
    for inclusive in (True, False):
        found = retention.expired_days(rows, inputs.AS_OF, inclusive=inclusive)
        found = found.select(
            F.lit(inclusive).alias("inclusive"),
            F.col("event_date").cast("string").alias("event_date"),
            "partition_rows",
            F.col("last_eviction").cast("string").alias("last_eviction"),
        )
        both = found if both is None else both.unionByName(found)
    return both


@query
def retained_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    kept = events.where(retention.retained(F.col("event_date"), inputs.AS_OF, 10))
    return by_day(kept)


@query
def day_table_retention(spark: SparkSession, folder: str) -> DataFrame:
    """Days left after dropping by age in the stored table."""
    table = DayTable(spark, scratch_path(spark, "retention"), STORED, ["event_id"])
    table.append(stored_columns(inputs.canonical_events(spark, folder)))
    retention.drop_old_days(table, inputs.AS_OF, 10)
    return by_day(table.read())


@query
def compact_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Two appended halves, compacted: same rows per day, fewer files."""
    events = inputs.canonical_events(spark, folder)
    table = DayTable(spark, scratch_path(spark, "compact"), STORED, sort=["user_id"])
    for half in (0, 1):
        table.append(stored_columns(events.where(f"event_id % 2 = {half}")))
    layout.compact(table, small_bytes=128 * 1024 * 1024)
    return by_day(table.read())


@query
def rebucket(spark: SparkSession, folder: str) -> DataFrame:
    events = stored_columns(inputs.canonical_events(spark, folder))
    root = scratch_path(spark, "rebucket")
    name = "sediment_" + root[-12:]
    joins.save_bucketed(events, f"{name}_old", f"{root}/old", ["event_id"], 7)
    copied = layout.rebucket(spark, f"{name}_old", f"{name}_new", f"{root}/new", ["event_id"], 21)
    return by_day(copied)


@query
def schema_evolve(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    metric = F.when(F.col("event_id") % 17 == 0, "T").otherwise(F.col("cents").cast("string"))
    old = events.select("event_id", "event_type", "props", metric.alias("metric"))
    changed = layout.evolve(
        old,
        add={"region": "string"},
        drop=["props"],
        rename={"event_type": "kind"},
        retype={"metric": "bigint"},
    )
    return changed.select(
        "event_id",
        "kind",
        F.coalesce("metric", F.lit(-1)).alias("metric"),
        F.coalesce("region", F.lit("none")).alias("region"),
        F.col("_failed").cast("bigint").alias("failed"),
    )


@query
def not_null_violations(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder).select(
        "event_id",
        F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 29 != 0, F.col("event_ts")).alias("event_ts"),
    )
    _, rejected = layout.not_null_violations(events, ["event_id", "user_id", "event_ts"])
    return rejected.select("event_id", "missing")
