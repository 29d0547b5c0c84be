import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of, values
from sediment.operators import joins, windows


def skewed(spark, n=3000):
    """A third of the rows share key 0."""
    k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(n).select("id", k.cast("long").alias("k"))


def lookup(spark):
    return spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_ways_agree(spark, how):
    rows, side = skewed(spark), lookup(spark)
    plain = values(rows.join(side, "k", how), "id")
    assert values(joins.lookup_join(rows, side, ["k"], how), "id") == plain
    assert values(joins.lookup_join(rows, side, ["k"], how, max_rows=10), "id") == plain
    salted = joins.lookup_join(rows, side, ["k"], how, spread="id", max_rows=10)
    assert values(salted, "id") == plain


def test_broadcast_depends_on_the_measured_size(spark):
    side = lookup(spark)
    assert joins.is_small(side)
    assert not joins.is_small(side, max_rows=399)
    assert not joins.is_small(side, max_bytes=1000)


def test_joins_on_buckets_need_no_shuffle_and_lose_no_hot_key(spark):
    rows, side = skewed(spark), lookup(spark)
    expected = values(rows.join(side, "k").select("id", "k", "v"), "id")
    pair = joins.BucketedPair(spark, 5, ["k"]).write(rows, side)
    assert values(pair.hot) == [(0,)]
    joined = pair.join()
    assert "hashpartitioning" not in plan_of(joined)
    assert values(joined.select("id", "k", "v"), "id") == expected
    shuffled = pair.join_shuffled(rows)
    assert plan_of(shuffled).count("hashpartitioning") == 1
    assert values(shuffled.select("id", "k", "v"), "id") == expected
    pair.drop()


def test_hourly_join_equals_the_pairs_it_avoids(spark):
    crashes = spark.createDataFrame(
        [(1, "2024-01-01 10:05:00"), (2, "2024-01-01 10:50:00"), (3, "2024-01-01 11:00:00"), (4, "2024-01-01 12:00:00")],
        "id int, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    weather = spark.createDataFrame(
        [("2024-01-01 10:15:00", "9", "0.1"), ("2024-01-01 10:45:00", "10", "0.05"), ("2024-01-01 10:55:00", "T", "9"),
         ("2024-01-01 11:59:59", "", None), ("2024-01-01 12:30:00", "30", "T")],
        "seen string, vis string, rain string",
    ).withColumn("seen", F.col("seen").cast("timestamp"))
    got = joins.incidents_in_band(crashes, weather, "id", "at", "seen", "vis", 0, 20, {"avg_vis": ("vis", 1)}, {"rain": "rain"})
    assert values(got) == [(2, 9.5, "0.1", "01 Jan 2024 10:00")]
    crashes.createOrReplaceTempView("c")
    weather.createOrReplaceTempView("w")
    pairs = spark.sql("""
      SELECT count(DISTINCT c.id), avg(try_cast(w.vis AS DOUBLE)), max(w.rain)
      FROM c LEFT JOIN w ON date_trunc('hour', c.at) = date_trunc('hour', w.seen)
      WHERE try_cast(w.vis AS DOUBLE) BETWEEN 0 AND 20 GROUP BY date_trunc('hour', c.at)""")
    assert values(pairs) == [(2, 9.5, "0.1")]
    kept = joins.with_hourly_readings(crashes, weather.where("vis <> ''"), "at", "seen", {"a": "vis"}, {"m": "rain"})
    assert values(kept.select("id", "readings"), "id") == [(1, 3), (2, 3), (3, 0), (4, 1)]


def test_range_windows_equal_plain_windows(spark):
    draw = random.Random(7)
    items = [(i, draw.choice([1, 1, 1, 2, None]), draw.choice([None, 0, 1, 90, 3600, 3601, 9000, 90000]), draw.randint(-9, 9)) for i in range(400)]
    rows = spark.createDataFrame(items, "id int, user int, sec int, amount long").withColumn("at", F.timestamp_seconds("sec"))
    total = windows.running_total(rows, ["user"], "at", ["id"], "amount", "total")
    diff = windows.difference_to_previous(rows, ["user"], "at", ["id"], "amount", "diff")
    rows.createOrReplaceTempView("r")
    plain = spark.sql("""
      SELECT id, sum(amount) OVER (PARTITION BY user ORDER BY at, id ROWS UNBOUNDED PRECEDING),
             coalesce(amount - lag(amount) OVER (PARTITION BY user ORDER BY at, id), 0) FROM r""")
    expected = values(plain, "id")
    assert values(total.select("id", "total"), "id") == [(i, t) for i, t, _ in expected]
    assert values(diff.select("id", "diff"), "id") == [(i, d) for i, _, d in expected]


def test_only_hot_keys_are_cut_into_ranges(spark):
    even = spark.range(1000).select("id", F.col("id").alias("user"), F.timestamp_seconds("id").alias("at"), F.lit(1).alias("amount"))
    assert "Union" not in plan_of(windows.running_total(even, ["user"], "at", ["id"], "amount", "t"))
    hot = even.withColumn("user", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("user")))
    cut = windows.running_total(hot, ["user"], "at", ["id"], "amount", "t")
    assert "Union" in plan_of(cut)
    assert values(cut.where("user IS NULL").select("t"), "t") == [(n,) for n in range(1, 335)]
    assert cut.where("user IS NOT NULL AND t <> 1").count() == 0


def test_rows_of_one_user_and_moment_are_dealt_over_many_tasks(spark):
    one = spark.range(4000).select("id", F.lit(7).alias("user"), F.timestamp_seconds(F.lit(0)).alias("at"), (F.col("id") % 11).alias("amount"))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    ranges = windows.ranges_of(one, ["user"], ["at", "id"])
    sizes = [n for _, n in values(ranges.groupBy("_range").count(), "_range")]
    total = windows.running_total(one, ["user"], "at", ["id"], "amount", "t")
    diff = windows.difference_to_previous(one, ["user"], "at", ["id"], "amount", "d")
    assert "rangepartitioning" not in plan_of(total)  # the ranges were written before
    expected, running = [], 0
    for i in range(4000):
        running += i % 11
        expected.append((i, running, i % 11 - (i - 1) % 11 if i else 0))
    got = values(total.select("id", "t").join(diff.select("id", "d"), "id"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == expected
    assert len(sizes) >= 8 and max(sizes) < 4000 / 4


def test_hot_keys_take_one_aggregate_and_the_bound(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id < 400 THEN 'a' WHEN id < 700 THEN NULL ELSE CAST(id AS STRING) END AS k", "id")
    assert values(joins.hot_keys(rows, ["k"], 2)) == [("a",)]
    assert values(joins.hot_keys(rows, ["k"], 2, nulls=True), "k") == [(None,), ("a",)]
    assert joins.hot_keys(rows.where("id >= 700"), ["k"], 2) is None
    assert joins.hot_keys(rows.where("false"), ["k"], 2) is None


def test_alert_levels(spark):
    checks = spark.createDataFrame(
        [("j", 1, 0, "RUNNING", 6), ("j", 2, 1, "RUNNING", 6), ("j", 3, 2, "RUNNING", 6), ("j", 4, 2, "RUNNING", 5),
         ("j", 5, 9, "PAUSED", 0), ("k", 1, 5, "RUNNING", 6), ("k", 2, 6, "RUNNING", 6)],
        "job_name string, checked_at int, error_rows int, state string, current_tasks int",
    )
    got = windows.job_alerts(checks, 6).select("job_name", "checked_at", "alert")
    assert [a for _, _, a in values(got, "job_name", "checked_at")] == ["ok", "ok", "warn", "info", "page", "ok", "ok"]


@pytest.mark.parametrize("kind", ["int", "decimal(10,2)", "bigint"])
def test_hot_keys_change_no_types(spark, kind):
    spread = spark.range(400).selectExpr("id % 100 AS k", "timestamp_seconds(id * 600) AS at", "id AS tie", f"CAST(id % 7 AS {kind}) AS v")
    hot = spread.withColumn("k", F.lit(1).cast("bigint"))
    for function in (windows.running_total, windows.difference_to_previous):
        even, skewed = (function(r, ["k"], "at", ["tie"], "v", "out") for r in (spread, hot))
        assert even.schema["v"] == skewed.schema["v"] and even.dtypes == skewed.dtypes
        assert even.columns == skewed.columns
    plain = Window.partitionBy("k").orderBy("at", "tie")
    expected = hot.withColumn("out", F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, 0)))
    assert values(windows.running_total(hot, ["k"], "at", ["tie"], "v", "out"), "tie") == values(expected, "tie")
    expected = hot.withColumn("out", F.coalesce(F.col("v") - F.lag("v").over(plain), F.lit(0)))
    assert values(windows.difference_to_previous(hot, ["k"], "at", ["tie"], "v", "out"), "tie") == values(expected, "tie")
