import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, values
from sediment.functions import sketches
from sediment.operators import aggregates, compliance, layout, reports, rollup
from sediment.sources.day_table import DayTable


def events(spark):
    rows = [("2024-01-01", "a", 1), ("2024-01-01", "a", 1), ("2024-01-01", "b", 2), ("2024-01-02", "a", 1), ("2024-01-02", None, 3)]
    frame = spark.createDataFrame(rows, "d string, event_type string, user_id long")
    return frame.select(F.to_date("d").alias("event_date"), "event_type", "user_id")


def test_router_uses_the_rollup_only_when_it_covers(spark):
    base = events(spark)
    grain = ["event_date", "event_type"]
    router = rollup.RollupRouter(base, rollup.daily_rollup(base, grain), grain)
    assert router.covers(["event_date"], ["event_count"])
    assert router.covers(grain, ["event_count", "unique_users"])
    assert not router.covers(["event_date"], ["unique_users"])
    assert not router.covers(["user_id"], ["event_count"])
    assert values(router.answer(["event_date"], ["unique_users"]), "event_date") == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 2), 2)]
    assert sorted(values(router.answer(["event_type"], ["event_count"])), key=str) == [("a", 3), ("b", 1), (None, 1)]


def test_rollup_refresh_touches_only_changed_days(spark, folder):
    schema = "event_date DATE, event_type STRING, user_id BIGINT"
    base = DayTable(spark, f"{folder}/base", schema)
    base.append(events(spark))
    table = DayTable(spark, f"{folder}/rollup", rollup.ROLLUP_SCHEMA)
    rollup.refresh_rollup(table, base, base.days())
    first = table.state()["base"]
    base.append(events(spark).where("event_date = DATE '2024-01-02'"))
    rollup.refresh_rollup(table, base, ["2024-01-02"])
    second = table.state()["base"]
    assert second["2024-01-01"] == first["2024-01-01"] and second["2024-01-02"] != first["2024-01-02"]
    daily = table.read().groupBy("event_date").agg(
        F.sum("event_count").alias("n"), sketches.sketch_count(sketches.sketch_union(F.col("users"))).alias("u")
    )
    assert values(daily, "event_date") == [(dt.date(2024, 1, 1), 3, 2), (dt.date(2024, 1, 2), 4, 2)]


def test_merged_states_equal_one_pass(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), (F.col("id") % 50).alias("u"))
    parts = [aggregates.aggregate_states(rows.where(f"v % 2 = {h}"), ["g"], F.col("v"), "u") for h in (0, 1)]
    merged = aggregates.read_states(aggregates.merge_states(*parts, ["g"]), ["g"])
    once = aggregates.read_states(aggregates.aggregate_states(rows, ["g"], F.col("v"), "u"), ["g"])
    assert values(merged, "g") == values(once, "g")


def test_states_are_added_to_the_stored_table_once(spark, folder):
    schema = "event_date DATE, n BIGINT, total BIGINT, low BIGINT, high BIGINT, users BINARY"
    table = DayTable(spark, folder, schema)
    day = F.to_date(F.lit("2024-01-01")).alias("event_date")

    def states(*ids):
        rows = spark.createDataFrame([(i,) for i in ids], "v long").select(day, "v")
        return aggregates.aggregate_states(rows, ["event_date"], F.col("v"), "v")

    rollup.add_states(table, states(1, 2), ["event_date"], ("load", 0))
    rollup.add_states(table, states(2, 9), ["event_date"], ("load", 1))
    rollup.add_states(table, states(2, 9), ["event_date"], ("load", 1))
    got = aggregates.read_states(table.read(), ["event_date"]).drop("event_date")
    assert values(got) == [(4, 14, 1, 9, 3)]


def test_sizes_defaults_and_timestamps(spark, folder):
    spark.range(10).repartition(2).write.parquet(folder)
    got = reports.table_sizes({"t": spark.read.parquet(folder)}).first()
    assert got["files"] == 2 and got["data_bytes"] > 0 and got["size"].endswith("iB") or got["size"].endswith(" B")
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), None)], "event_ts timestamp, at timestamp")
    filled = layout.with_defaults(rows, {"at": F.current_timestamp()})
    assert filled.where("at IS NULL").count() == 0
    assert layout.as_millis(rows, "event_ts").first()["event_ts"] == 1_704_067_200_000


def test_aggregates_combine_before_the_shuffle(spark):
    plan = plan_of(aggregates.count_by(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], "n", 1))
    assert "TakeOrderedAndProject" in plan and plan.index("Exchange") < plan.index("partial_count")


def test_capacity_grid_of_the_planning_table(spark):
    """The six published sizes, with 643 million rows per shard and day."""
    rates = spark.createDataFrame([(643_000_000,)], "rows_per_day long")
    got = {
        (r["bytes_per_row"], r["retention_days"]): tuple(r[c] / 1e9 for c in ("total_bytes", "cache_bytes", "volume_bytes"))
        for r in reports.capacity_grid(rates).collect()
    }
    golden = {
        (50, 30): (965, 241, 278),
        (50, 90): (2900, 725, 833),
        (100, 30): (1930, 482, 554),
        (100, 90): (5800, 1440, 1660),
        (200, 30): (3850, 963, 1110),
        (200, 90): (11600, 2900, 3330),
    }
    for cell, sizes in golden.items():
        assert got[cell] == pytest.approx(sizes, rel=0.01)
    # 10 percent duplicates give that rate; 15 percent would not.
    assert round(5e9 * 0.90 / 7 / 1e6) == 643


def test_calendar_and_window(spark):
    base = events(spark)
    calendar = layout.partition_calendar(base, "event_date", "2024-01-02", back=2, ahead=1)
    assert values(calendar.select("partition_name", "has_rows", "upcoming"), "partition_name") == [
        ("p20231231", False, False),
        ("p20240101", True, False),
        ("p20240102", True, True),
        ("p20240103", False, True),
    ]
    assert base.where(layout.outside_window(F.col("event_date"), "2024-01-05", back=3, ahead=3)).count() == 3


def test_audit_lag_and_pressure(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "path string")
    assert values(reports.storage_audit(names("a", "b"), names("b", "c")), "path") == [("a", "orphan"), ("b", "ok"), ("c", "missing")]
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, 7)], "topic string, partition int, end_offset long")
    done = spark.createDataFrame([("g", "t", 0, 4)], "group_id string, topic string, partition int, committed_offset long")
    assert values(reports.consumer_lag(ends, done)) == [("g", 13, 2)]
    files = spark.range(4).select(F.lit("d").alias("day"), F.col("id").alias("file"))
    assert values(reports.part_pressure(files, ["day"], 4, 5)) == [("d", 4, "slow")]
    assert values(reports.part_pressure(files, ["day"], 2, 4)) == [("d", 4, "stop")]


def test_schema_changes(spark):
    rows = spark.createDataFrame([(1, "12", "x"), (2, "T", "y"), (3, None, "z")], "id int, m string, gone string")
    got = layout.evolve(rows, add={"region": "string"}, drop=["gone"], rename={"id": "key"}, retype={"m": "int"})
    assert values(got, "key") == [(1, 12, 0, None), (2, None, 1, None), (3, None, 0, None)]
    assert layout.union_versions(rows.drop("gone"), rows).columns == ["id", "m", "gone"]
    accepted, rejected = layout.not_null_violations(rows, ["id", "m"])
    assert accepted.count() == 2 and values(rejected.select("id", "missing")) == [(3, "m")]


def test_rebucket_and_skew(spark, folder):
    from sediment.operators.joins import save_bucketed

    rows = spark.range(1000).select(F.col("id").alias("k"))
    save_bucketed(rows, "old_buckets", f"{folder}/old", ["k"], 7)
    assert layout.rebucket(spark, "old_buckets", "new_buckets", f"{folder}/new", ["k"], 21).count() == 1000
    skew = layout.bucket_skew(rows, "k").first()
    assert skew["total_rows"] == 1000 and skew["used_buckets"] == 21
    for name in ("old_buckets", "new_buckets"):
        layout.drop_table(spark, name)


def test_nightly_batch(spark, folder):
    schema = "event_id BIGINT, user_id BIGINT, event_date DATE, eviction_date DATE"
    day = F.lit("2024-01-01").cast("date")
    table = DayTable(spark, f"{folder}/t", schema, ["event_id"])
    table.append(spark.range(6).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), day.alias("event_date"), day.alias("eviction_date")))
    staging = DayTable(spark, f"{folder}/s", compliance.STAGING_SCHEMA, day="batch_date")
    evidence = DayTable(spark, f"{folder}/e", compliance.EVIDENCE_SCHEMA, day="batch_date")
    staging.append(
        spark.createDataFrame([("DELETE", 0, None), ("DELETE", 0, None), ("UPDATE", 1, "2024-09-09")], "operation string, user_id long, n string")
        .select(F.lit("2024-02-01").cast("date").alias("batch_date"), "operation", "user_id", F.to_date("n").alias("new_eviction_date"))
    )
    compliance.nightly_batch(table, staging, evidence, "2024-02-01")
    got = table.read().select("user_id", F.col("eviction_date").cast("string")).distinct()
    assert values(got, "user_id") == [(1, "2024-09-09"), (2, "2024-01-01")]
    assert staging.read().count() == 0
    again = spark.createDataFrame([(0,), (2,)], "user_id long").select(
        F.lit("2024-02-01").cast("date").alias("batch_date"), F.lit("DELETE").alias("operation"), "user_id", F.lit(None).cast("date").alias("new_eviction_date")
    )
    first_entry = evidence.read().first()
    staging.append(again)
    compliance.nightly_batch(table, staging, evidence, "2024-02-01")
    assert evidence.read().where("user_id = 0").first() == first_entry
    assert values(evidence.read().select("user_id"), "user_id") == [(0,), (2,)]
    assert values(table.read().select("user_id").distinct()) == [(1,)]
    report = compliance.sla_report(evidence.read())
    assert values(report.select("user_id", "within_sla"), "user_id") == [(0, False), (2, False)]


def test_sla_boundary(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, at + dt.timedelta(hours=24)), (2, at, at + dt.timedelta(hours=24, seconds=1)), (3, at, None)]
    frame = spark.createDataFrame(rows, "user_id int, requested_at timestamp, removed_at timestamp")
    assert [r["within_sla"] for r in compliance.sla_report(frame).orderBy("user_id").collect()] == [True, False, False]
