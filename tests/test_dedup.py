import datetime as dt

from pyspark.sql import functions as F

from conftest import SMALL, plan_of, values
from sediment.operators import dedup
from sediment.plans.catalog import catalog


def test_equal_versions_are_decided_by_the_tiebreak(spark):
    rows = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (2, 1, 9, "c"), (2, 3, 1, "d")], "k int, v int, seq int, p string")
    got = dedup.keep_latest_version(rows, ["k"], "v", [F.col("seq").desc()])
    assert values(got.select("k", "p"), "k") == [(1, "b"), (2, "d")]


def test_versions_are_replaced_within_a_partition_only(spark):
    rows = spark.createDataFrame([(1, "d1", 1), (1, "d2", 2)], "k int, day string, v int")
    assert dedup.keep_latest_version(rows, ["k"], "v", ["day"], within=["day"]).count() == 2
    assert dedup.keep_latest_version(rows, ["k"], "v", ["day"]).count() == 1


def test_copies_of_a_hot_key_are_cut_before_the_shuffle(spark):
    rows = spark.range(100_000).select((F.col("id") % 3 == 0).cast("int").alias("hot"), "id")
    rows = rows.select(F.when(F.col("hot") == 1, 0).otherwise(F.col("id")).alias("k"), "id")
    latest = dedup.keep_latest_version(rows, ["k"], "id", ["k"])
    plan = plan_of(latest)
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    assert latest.where("k = 0").first()["id"] == 99_999


def test_fingerprint_ignores_order_but_not_repetition(spark):
    def prints(rows):
        frame = spark.createDataFrame(rows, "b int, x int")
        return values(dedup.batch_fingerprints(frame, ["b"], ["x"]).select(*dedup.FINGERPRINT))

    assert prints([(1, 1), (1, 2)]) == prints([(1, 2), (1, 1)])
    assert prints([(1, 1), (1, 1)]) != prints([(1, 2), (1, 2)])


def ledger_case(spark, ages_in_hours, last, days):
    now = dt.datetime(2024, 1, 20)
    ledger = spark.createDataFrame(
        [(1, n, str(n), now - dt.timedelta(hours=h)) for n, h in enumerate(ages_in_hours)],
        "batch_rows int, hash_xor int, hash_sum string, accepted_at timestamp",
    )
    live = dedup.live_ledger(ledger, F.lit(now), last, days)
    incoming = ledger.select(*dedup.FINGERPRINT).withColumn("arrival", F.lit(1))
    incoming = incoming.unionByName(incoming.withColumn("arrival", F.lit(2)))
    return values(dedup.unseen_batches(incoming, live, ["arrival"]).select("hash_xor", "arrival"), "hash_xor")


def test_batch_after_eight_days_is_accepted_once(spark):
    assert ledger_case(spark, [1, 24 * 8], 1000, 7) == [(1, 1)]


def test_batch_beyond_the_last_entries_is_accepted(spark):
    assert ledger_case(spark, [1, 2, 3], 2, 7) == [(2, 1)]


def test_duplicate_rate(spark):
    rows = spark.createDataFrame([("d", 1), ("d", 1), ("d", 2), ("e", 1)], "day string, k int")
    assert values(dedup.duplicate_rate(rows, ["day"], ["k"]), "day") == [
        ("d", 3, 2, 1, 0.333333),
        ("e", 1, 1, 0, 0.0),
    ]


def test_ledger_without_a_count_holds_every_batch_of_seven_days(spark):
    now = F.lit("2024-03-08").cast("timestamp")
    ledger = spark.range(1500).selectExpr("TIMESTAMP'2024-03-01 00:30:00' + make_interval(0,0,0,0,0,id) AS accepted_at", "1L AS batch_rows", "id AS hash_xor", "'x' AS hash_sum")
    repeat = spark.sql("SELECT 1L AS batch_rows, 3L AS hash_xor, 'x' AS hash_sum, 1 AS seq")
    assert dedup.unseen_batches(repeat, dedup.live_ledger(ledger, now), ["seq"]).isEmpty()
    assert dedup.unseen_batches(repeat, dedup.live_ledger(ledger, now, last=1000), ["seq"]).count() == 1


def test_ledger_by_time_takes_no_batch_of_the_last_seven_days(spark):
    by_time, limited = (
        {r.batch_hour for r in catalog()[name](spark, SMALL).collect()} for name in ("batch_ledger_by_time", "batch_ledger_dedup")
    )
    live = {h for h in limited if "2024-01-13 00" < h <= "2024-01-20 00"}
    assert live and by_time == limited - live
