"""Plain folders: lookups, footers, deletes, audits; sketches, variants, bucket counts and file loading."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, values
from sediment.operators import folders, joins, layout, rollup
from sediment.sources import decode, files


def people(spark, n=60_000, users=3_000):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int"))
    return spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(users)).alias("user_id"), day.alias("event_date"))


def test_a_lookup_reads_less_than_a_tenth_and_finds_every_row(spark, folder):
    rows = people(spark, 400_000)
    folders.write_days(rows, folder, "event_date", "user_id")
    ids = spark.createDataFrame([(u,) for u in (3, 700, 1500, 2222, 2999, None)], "user_id long")
    found = folders.rows_of_users(spark.read.parquet(folder), ids)
    got = sorted(r["id"] for r in found.collect())
    assert got == sorted(r["id"] for r in rows.where("user_id IN (3, 700, 1500, 2222, 2999)").collect()) and got
    assert folders.rows_scanned(found) < 40_000
    assert "In(user_id" in plan_of(found)


def test_bloom_filters_skip_unsorted_files(spark, folder):
    """Files of random users, whose statistics say nothing: the filter alone skips those without the user."""
    rows = people(spark, 40_000, 10**9)
    writer = rows.repartition(16).write.option("parquet.bloom.filter.enabled#user_id", "true")
    writer.option("parquet.bloom.filter.expected.ndv#user_id", "5000").parquet(folder)
    one = rows.limit(1).select("user_id")
    found = folders.rows_of_users(spark.read.parquet(folder), one)
    assert found.count() >= 1
    found.collect()
    assert folders.rows_scanned(found) < 10_000


def test_many_ids_are_joined(spark, folder):
    rows = people(spark, 5_000)
    folders.write_days(rows, folder, "event_date", "user_id")
    ids = spark.range(1_500).select(F.col("id").alias("user_id"))
    assert folders.few_ids(ids, "user_id") is None
    found = folders.rows_of_users(spark.read.parquet(folder), ids)
    assert found.count() == rows.where("user_id < 1500").count()


def test_deletes_rewrite_only_their_days_and_remove_empty_ones(spark, folder):
    rows = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1)), (2, 2, dt.date(2024, 1, 2)), (3, 1, dt.date(2024, 1, 3)), (4, 2, dt.date(2024, 1, 3)), (5, None, dt.date(2024, 1, 3))], "id long, user_id long, event_date date")
    folders.write_days(rows, folder, "event_date", "user_id")
    before = {f for f in os.listdir(f"{folder}/event_date=2024-01-02")}
    assert folders.delete_users(spark, folder, spark.createDataFrame([(1,)], "user_id long")) == ["2024-01-01", "2024-01-03"]
    assert values(spark.read.parquet(folder).select("id"), "id") == [(2,), (4,), (5,)]
    assert {f for f in os.listdir(f"{folder}/event_date=2024-01-02")} == before
    assert not os.path.exists(f"{folder}/event_date=2024-01-01")
    assert folders.delete_users(spark, folder, spark.createDataFrame([(77,)], "user_id long")) == []


def test_expiry_comes_from_footers(spark, folder):
    day, late = dt.date(2024, 1, 1), dt.date(2024, 3, 1)
    rows = [(day, dt.date(2024, 1, 5)), (day, dt.date(2024, 1, 9)), (dt.date(2024, 1, 2), None), (dt.date(2024, 1, 2), dt.date(2024, 1, 3)), (dt.date(2024, 1, 3), late), (dt.date(2024, 1, 4), dt.date(2024, 1, 20))]
    spark.createDataFrame(rows, "event_date date, eviction_date date").write.partitionBy("event_date").parquet(folder)
    found = folders.expired_days(spark, folder, "2024-01-20")
    assert "PushedAggregation: [MAX(eviction_date)" in plan_of(found)
    assert [str(r["event_date"]) for r in found.orderBy("event_date").collect()] == ["2024-01-01", "2024-01-04"]
    strict = folders.expired_days(spark, folder, "2024-01-20", inclusive=False)
    assert folders.drop_days(spark, folder, strict) == ["2024-01-01"]
    assert spark.read.parquet(folder).count() == 4
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_audit_finds_missing_orphaned_and_resized_files(spark, folder):
    rows = people(spark, 400)
    folders.write_days(rows, f"{folder}/t", "event_date", "user_id")
    folders.register_files(spark, f"{folder}/t", f"{folder}/m")
    names = sorted(r["file"] for r in folders.file_list(spark, f"{folder}/t").collect())
    paths = [n.removeprefix("file:").replace("///", "/") for n in names]
    os.remove(paths[0])
    spark.range(5).withColumn("user_id", F.lit(1).cast("long")).coalesce(1).write.mode("append").parquet(f"{folder}/t/event_date=2024-01-01")
    with open(paths[1], "ab") as f:
        f.write(b"x")
    got = folders.audit_files(spark, f"{folder}/t", f"{folder}/m").groupBy("status").count()
    assert dict(values(got, "status")) == {"missing": 1, "ok": 2, "orphan": 1, "resized": 1}


def test_delete_plan_counts_shared_files_and_users(spark, folder):
    rows = [(1, "2024-01-01"), (2, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"), (9, "2024-01-03")]
    frame = spark.createDataFrame(rows, "user_id long, d string").selectExpr("user_id", "CAST(d AS DATE) AS event_date")
    folders.write_days(frame, folder, "event_date", "user_id")
    plan = folders.delete_plan(spark, folder, spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long"))
    assert values(plan.select("user", "units", "shared_units", "shared_users"), "user") == [(1, 1, 1, 1), (2, 2, 1, 1), (3, 1, 0, 0)]
    assert plan.where("bytes < 100").count() == 0


def test_router_estimates_users_from_stored_sketches(spark, folder):
    events = spark.range(40_000).selectExpr("id % 7 AS day", "id % 3 AS kind", "pmod(xxhash64(id), 9000) AS user_id")
    rollup.rollup_with_sketch(events, ["day", "kind"]).write.parquet(f"{folder}/sketches")
    events.write.parquet(f"{folder}/base")
    stored = spark.read.parquet(f"{folder}/sketches")
    router = rollup.RollupRouter(spark.read.parquet(f"{folder}/base"), stored, ["day", "kind"])
    exact = dict(values(events.groupBy("kind").agg(F.count_distinct("user_id").alias("n"))))
    got = router.answer(["kind"], ["event_count", "approx_users"])
    assert f"{folder}/base" not in plan_of(got)
    for kind, n, users in values(got):
        assert n in (13333, 13334) and abs(users - exact[kind]) <= 4 * rollup.SKETCH_ERROR * exact[kind]
    plain = rollup.RollupRouter(events, stored.drop("users"), ["day", "kind"])
    assert not plain.covers(["kind"], ["approx_users"])
    assert dict(values(plain.answer(["kind"], ["approx_users"]))) == exact


def test_variants_tell_bad_messages_from_bad_values(spark):
    texts = ['{"a": {"b": [1, 2]}, "n": 5}', '{"a": {"b": []}, "n": "x"}', "{broken", None, '{"n": null}', "[1]"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, value string")
    got = decode.decode_variant(rows, "first INT, n BIGINT", paths={"first": "$.a.b[0]"})
    assert values(got.select("k", "first", "n", "_error"), "k") == [
        (0, 1, 5, None), (1, None, None, "bad value: n"), (2, None, None, "malformed message"),
        (3, None, None, "malformed message"), (4, None, None, None), (5, None, None, None),
    ]
    loose = decode.decode_variant(rows, "n BIGINT", strict=False)
    assert loose.where("_error IS NOT NULL").count() == 2
    assert plan_of(got.where("_error IS NULL")).count("parseJson") == 1
    assert decode.variant_schema(rows.limit(1)) == "OBJECT<a: OBJECT<b: ARRAY<BIGINT>>, n: BIGINT>"


def test_bucket_counts_follow_the_bytes(spark):
    rows = spark.range(20_000).selectExpr("id % 900 AS k", "repeat('x', 40) AS text")
    lookup = spark.range(900).selectExpr("id AS k", "id * 2 AS v")
    n, size = joins.measured(rows)
    assert (n, size) == (20_000, 20_000 * 48)
    assert joins.bucket_count(rows, size // 4) == 4 or joins.bucket_count(rows, size // 4) == 5
    assert joins.bucket_count(rows.where("false")) == 1
    big, small = (joins.BucketedPair.sized(r, lookup, ["k"], size // 8) for r in (rows, rows.limit(4_000)))
    counts = [joins.stored_buckets(spark, f"{p.prefix}_rows") for p in (big, small)]
    assert counts[0] > counts[1] >= 1
    for pair, expected in ((big, 20_000), (small, 4_000)):
        joined = pair.join()
        assert "Exchange" not in plan_of(joined) and joined.count() == expected
    shuffled = big.join_shuffled(rows.selectExpr("k", "k AS w"))
    assert shuffled.count() == 20_000
    for pair in (big, small):
        pair.drop()


def test_rows_of_a_file_have_positions(spark, folder):
    rows = spark.range(6).selectExpr("id % 2 AS k", "id AS v")
    rows.coalesce(1).write.parquet(f"{folder}/in")
    rows.write.json(f"{folder}/json")

    def offsets(stream):
        stream.writeStream.format("memory").queryName("positions").trigger(availableNow=True).start().awaitTermination()
        return [o for _, o in values(spark.table("positions").select("value", "offset"), "offset")]

    assert offsets(files.as_messages(files.file_stream(spark, f"{folder}/in", "parquet", "k BIGINT, v BIGINT"))) == [*range(6)]
    text = files.file_stream(spark, f"{folder}/json", "json", "k BIGINT, v BIGINT")
    with pytest.raises(ValueError, match="sequence"):
        files.as_messages(text)
    assert offsets(files.as_messages(text, sequence="v")) == [*range(6)]


def test_a_failed_group_is_halved(spark, folder):
    spark.range(64).repartition(32).write.json(f"{folder}/in")
    names = sorted(f for f in os.listdir(f"{folder}/in") if f.endswith(".json"))
    bad = names[5]
    calls = []

    def take(paths):
        calls.append(len(paths))
        if any(bad in p for p in paths):
            raise ValueError("bad file")

    assert files.load_new_files(spark, f"{folder}/in", f"{folder}/ledger", take, glob="*.json") == len(names) - 1
    assert len(calls) <= 12
    failed = files.current_file_states(files.read_ledger(spark, f"{folder}/ledger")).where("state = 'ERROR'")
    assert [bad in r["path"] and "bad file" in r["error"] for r in failed.collect()] == [True]


def test_inserts_take_defaults_by_name(spark, folder):
    name = "defaults_" + os.path.basename(folder)[:8]
    layout.create_table(spark, name, {"a": "INT", "b": "STRING DEFAULT 'x'", "c": "INT DEFAULT 7"})
    layout.insert_rows(spark.createDataFrame([(1, 2)], "c int, a int"), name)
    layout.insert_rows(spark.createDataFrame([(3,)], "a int"), name)
    layout.add_columns(spark, name, {"d": "INT DEFAULT 9"})
    assert values(spark.table(name), "a") == [(2, "x", 1, 9), (3, "x", 7, 9)]
    layout.insert_rows(spark.createDataFrame([(4,)], "a int"), name, replace=True)
    assert values(spark.table(name)) == [(4, "x", 7, 9)]
    layout.empty_table(spark, name)
    assert spark.table(name).count() == 0
    layout.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)
