"""Joins, aggregates, window functions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import numbers, sketches, times
from sediment.operators import aggregates, joins, reports, rollup, windows
from sediment.plans import inputs
from sediment.plans.registry import query
from sediment.plans.tables import stored_columns

MOST_SETS = 100


@query
def top_sites(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.count_by(inputs.clicks(spark, folder), ["site"], "visits")


@query
def unique_users_by_site(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.distinct_by(inputs.clicks(spark, folder), ["site"], "uid", "unique_users")


@query
def visits_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    hours = aggregates.count_by_bucket(
        inputs.clicks(spark, folder),
        times.hour_from_seconds(F.col("vtime")),
        {"visits": F.count(F.lit(1))},
        most=24,
        latest=True,
    )
    return hours.select(times.timestamp_text(F.col("bucket")).alias("hour"), "visits")


@query
def events_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    hours = aggregates.count_by_bucket(
        inputs.incidents(inputs.canonical_events(spark, folder)),
        times.hour_of(F.col("ts")),
        {"incidents": F.count(F.lit(1))},
        most=48,
        latest=False,
    )
    return hours.select(times.timestamp_text(F.col("bucket")).alias("hour"), "incidents")


@query
def avg_text_metric_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    hours = aggregates.count_by_bucket(
        inputs.readings(inputs.canonical_events(spark, folder)),
        times.hour_of(F.col("ts")),
        {"avg_metric": F.round(F.avg(numbers.lenient_double(F.col("metric"))), 6)},
        most=48,
        latest=False,
    )
    return hours.select(times.timestamp_text(F.col("bucket")).alias("hour"), "avg_metric")


def _in_band(spark: SparkSession, folder: str, low: float, high: float) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    return joins.incidents_in_band(
        inputs.incidents(events),
        inputs.readings(events),
        "incident_id",
        "ts",
        "ts",
        "metric",
        low,
        high,
        averages={"avg_metric": ("metric", 1)},
        text_max={"max_metric": "metric"},
    )


@query
def errors_in_low_range(spark: SparkSession, folder: str) -> DataFrame:
    return _in_band(spark, folder, 0.0, 20.0)


@query
def errors_in_mid_range(spark: SparkSession, folder: str) -> DataFrame:
    return _in_band(spark, folder, 20.0, 60.0)


@query
def hourly_left_join(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    joined = joins.with_hourly_readings(
        inputs.incidents(events),
        inputs.readings(events).where("metric <> 'T'"),
        "ts",
        "ts",
        {"avg_metric": "metric"},
        {"max_metric": "metric"},
    )
    return joined.select(
        "incident_id",
        "readings",
        F.round(F.coalesce("avg_metric", F.lit(-1.0)), 6).alias("avg_metric"),
        F.coalesce("max_metric", F.lit("none")).alias("max_metric"),
    )


@query
def broadcast_join(spark: SparkSession, folder: str) -> DataFrame:
    customers = inputs.table(spark, folder, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    nations = inputs.table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = customers.join(joins.broadcast_if_small(nations), "n_nationkey")
    return joined.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(numbers.hundredths(F.col("c_acctbal"))).alias("balance_cents")
    )


def _lines_and_orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = inputs.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_quantity").cast("bigint").alias("quantity")
    )
    orders = inputs.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orderkey"), "o_orderstatus", "o_orderpriority"
    )
    return lines, orders


@query
def shuffle_hash_join(spark: SparkSession, folder: str) -> DataFrame:
    """The hash table is built from the side with one row per key."""
    lines, orders = _lines_and_orders(spark, folder)
    return lines.join(orders.hint("shuffle_hash"), "orderkey").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("sum_qty")
    )


@query
def salted_lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    """The join that deals the rows of a key over several tasks, with the broadcast switched off."""
    lines, orders = _lines_and_orders(spark, folder)
    joined = joins.lookup_join(lines, orders, ["orderkey"], "inner", spread="quantity", max_rows=0)
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("sum_qty")
    )


@query
def colocated_join(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = _lines_and_orders(spark, folder)
    pair = joins.BucketedPair(spark, 21, ["orderkey"]).write(lines, orders)
    return pair.join().groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("sum_qty")
    )


@query
def bucket_shuffle_join(spark: SparkSession, folder: str) -> DataFrame:
    """One side stored in buckets, the other shuffled into them."""
    lines, orders = _lines_and_orders(spark, folder)
    pair = joins.BucketedPair(spark, 21, ["orderkey"]).write_lookup(orders)
    return pair.join_shuffled(lines).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("sum_qty")
    )


@query
def storage_audit(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    path = F.concat_ws("/", F.col("event_date").cast("string"), (F.col("event_id") % 21).cast("string"))
    listed = events.where("event_id % 21 % 7 <> 0").select(path.alias("path"))
    registered = events.where("event_id % 21 % 11 <> 0").select(path.alias("path"))
    return reports.storage_audit(listed, registered)


@query
def approx_users(spark: SparkSession, folder: str) -> DataFrame:
    found = aggregates.approximate_distinct_by(inputs.table(spark, folder, "events"), ["event_type"], "user_id")
    near = F.col("exact_users") * 0.05
    return found.select(
        "event_type",
        "exact_users",
        (F.abs(F.col("approx_users") - F.col("exact_users")) <= near).alias("approx_close"),
        (F.abs(F.col("sketch_users") - F.col("exact_users")) <= near).alias("sketch_close"),
    )


@query
def bitmap_distinct(spark: SparkSession, folder: str) -> DataFrame:
    bitmaps = sketches.id_bitmaps(inputs.table(spark, folder, "events"), ["event_type"], "user_id")
    return sketches.bitmap_cardinality(bitmaps, ["event_type"], "users")


@query
def set_overlap(spark: SparkSession, folder: str) -> DataFrame:
    bitmaps = sketches.id_bitmaps(inputs.table(spark, folder, "events"), ["event_type"], "user_id")
    found = bitmaps.select("event_type").where("event_type IS NOT NULL").distinct().orderBy("event_type")
    kinds = [r[0] for r in found.limit(MOST_SETS + 1).collect()]
    if len(kinds) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets: name the pairs")
    pairs = [(a, b) for a in kinds for b in kinds if a < b]
    return sketches.set_sizes(bitmaps, "event_type", pairs)


@query
def layout_summary(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    bucket = (F.col("event_id") % 21).alias("bucket")
    broken = (F.dayofmonth("event_date") % 7 == 0) & (F.col("bucket") == 20)
    parts = (
        events.groupBy("event_date", bucket)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(times.hour_of(F.col("ts"))).alias("versions"))
        .withColumn("state", F.when(broken, "DECOMMISSION").otherwise("NORMAL"))
    )
    summary = reports.layout_summary(parts, ["event_date"], compaction_lag=14)
    return summary.withColumn("event_date", F.col("event_date").cast("string"))


@query
def part_pressure(spark: SparkSession, folder: str) -> DataFrame:
    """Files per day, one for each minute with events, against the two limits."""
    events = inputs.canonical_events(spark, folder)
    files = events.select(
        F.col("event_date").cast("string").alias("event_date"),
        F.date_format("ts", "HHmm").alias("file"),
    )
    return reports.part_pressure(files, ["event_date"], slow=290, stop=320)


@query
def hit_ratio(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    day = events.withColumn("event_date", F.col("event_date").cast("string"))
    kind = F.col("event_type")
    return aggregates.hit_ratio(day, ["event_date"], kind == "click", kind == "view")


@query
def avg_row_chars(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.per_row_average(inputs.table(spark, folder, "documents"), ["lang"], F.length("text"))


@query
def daily_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    daily = rollup.daily_rollup(inputs.canonical_events(spark, folder))
    return daily.withColumn("event_date", F.col("event_date").cast("string"))


@query
def rollup_equals_base(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    grain = ["event_date", "event_type"]
    router = rollup.RollupRouter(events, rollup.daily_rollup(events, grain), grain)
    from_rollup = router.answer(["event_type"], ["event_count"])
    from_base = rollup.daily_rollup(events, ["event_type"]).withColumnRenamed("event_count", "base_count")
    return from_rollup.join(from_base, "event_type").select(
        "event_type",
        "event_count",
        "unique_users",
        (F.col("event_count") == F.col("base_count")).alias("matches"),
    )


@query
def running_difference(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder).select("event_id", "user_id", "ts", "cents")
    found = windows.difference_to_previous(events, ["user_id"], "ts", ["event_id"], "cents", "difference")
    return found.select("event_id", "user_id", "difference")


@query
def running_accumulate(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder).select("event_id", "user_id", "ts", "cents")
    found = windows.running_total(events, ["user_id"], "ts", ["event_id"], "cents", "accumulated")
    return found.select("event_id", "user_id", "accumulated")


@query
def job_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly checks of five jobs, one per event type; large values stand for errors."""
    events = inputs.canonical_events(spark, folder)
    hour = F.floor(F.unix_seconds("ts") / 3600)
    checks = (
        events.groupBy(F.col("event_type").alias("job_name"), hour.alias("checked_at"))
        .agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("cents") > 1500).alias("error_rows"))
        .withColumn("state", F.when(F.col("checked_at") % 97 == 0, "PAUSED").otherwise("RUNNING"))
        .withColumn("current_tasks", F.when(F.col("checked_at") % 5 == 0, 5).otherwise(6))
    )
    return windows.job_alerts(checks, 6).select("job_name", "checked_at", "error_rows", "alert")


@query
def partition_report(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    return reports.partition_report(events, "event_date", F.length("props") * 1_000_000)


@query
def capacity_projection(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    rates = events.groupBy("event_type").agg(
        F.floor(F.count(F.lit(1)) / F.count_distinct("event_date")).alias("rows_per_day")
    )
    grid = reports.capacity_grid(rates)
    return grid.select(
        "event_type",
        "rows_per_day",
        F.col("bytes_per_row").cast("bigint").alias("bytes_per_row"),
        F.col("retention_days").cast("bigint").alias("retention_days"),
        *[F.round(c, 2).alias(c) for c in ("total_bytes", "cache_bytes", "volume_bytes")],
    )


@query
def ingest_rate(spark: SparkSession, folder: str) -> DataFrame:
    return reports.ingest_rate(
        stored_columns(inputs.canonical_events(spark, folder), "event_ts"),
        F.floor(F.col("event_ts") / 1000),
        tasks=6,
        interval_seconds=10,
    )
