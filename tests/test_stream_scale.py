"""What keeps the streams' cost in proportion to their input."""

import datetime as dt
import random

import pyarrow as pa

from pyspark.sql import functions as F

from conftest import values
from sediment.plans import streams
from sediment.sources import message_log, messages
from sediment.streaming import ingest, load, stateful


def changes_of(spark, folder, rows, **more):
    """Newest rows of ``k, at, v`` in three batches, and the query."""
    for k in range(3):
        some = rows[k::3]
        spark.createDataFrame(some, "k long, at long, v string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema("k long, at long, v string").option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    changes = stateful.newest_rows(source, ["k"], ["at"], **more)

    def keep(batch, number):
        load.write_partitions(batch.withColumn("n", F.lit(number)), f"{folder}/out", ["n"])

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.foreachBatch(keep).trigger(processingTime="1 second").start()
    load.drain_rows(query, len(rows))
    found = stateful.latest_changes(spark.read.parquet(f"{folder}/out"), ["k"], F.col("n"))
    return values(found.select("k", "at", "v"), "k"), query


def some_rows():
    rows = [(k % 40 if k % 41 else None, k, f"v{k}") for k in range(600)]
    random.Random(1).shuffle(rows)
    newest = {}
    for k, at, v in rows:
        newest[k] = max(newest.get(k, (-1, "")), (at, v))
    return rows, sorted(((k, *x) for k, x in newest.items()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_newest_rows_without_a_time_are_an_aggregate_of_spark(spark, folder):
    rows, expected = some_rows()
    got, query = changes_of(spark, folder, rows)
    assert got == expected
    assert {s["operatorName"] for s in query.lastProgress["stateOperators"]} == {"stateStoreSave"}


def test_newest_rows_with_a_time_share_state_values(spark, folder):
    rows, expected = some_rows()
    got, query = changes_of(spark, folder, rows, keep="7 days", slots=5)
    assert got == expected
    assert 0 < max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 2 * 5  # values and their times


def test_a_reading_task_opens_its_files_only_and_holds_few_pages(spark, folder):
    at = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    body = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.sha2((F.col("id") * 8 + k).cast("string"), 256)))
    for first in (0, 100_000):
        rows = spark.range(first, first + 100_000).select(F.lit(None).cast("string").alias("key"), body.alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), at.alias("timestamp"))
        message_log.write_log(rows.coalesce(1), f"{folder}/log")
    reader = message_log.LogReader({"path": f"{folder}/log", "positions": f"{folder}/p.json", "start": '"beginning"', "taskrows": "50000"})
    tasks = reader.partitions({"0": 0}, {"0": 200_000})
    most = max(len(t.files) for t in tasks)
    assert len(tasks) == 4 and most < len(reader.bounds)
    before, peak, seen = pa.total_allocated_bytes(), 0, []
    for task in tasks:
        for batch in reader.read(task):
            peak = max(peak, pa.total_allocated_bytes() - before)
            seen += batch.column("offset").to_pylist()
    assert sorted(seen) == [*range(200_000)] and batch.schema.names == [f.split()[0] for f in messages.MESSAGE_SCHEMA.split(", ")]
    assert peak < 30 << 20  # all 50 MB of a file's texts before


def events_of(spark, folder, n, seconds=1):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * seconds)
    columns = ["id AS event_id", "id % 50 + 1 AS user_id", "'view' AS event_type", "id / 4 AS value", "'{}' AS props"]
    spark.range(n).withColumn("ts", at).selectExpr(*columns, "ts").write.parquet(f"{folder}/events.parquet")
    return folder


def test_the_stored_log_has_more_files_when_it_has_more_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 500)
    log = spark.read.parquet(streams.message_log(spark, events_of(spark, folder, 6000)))
    sizes = [r["count"] for r in log.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * 6000 * 8 / 7 / len(sizes)
    once = log.select("key", F.input_file_name().alias("file")).distinct()
    assert once.count() == once.select("key").distinct().count() == 6000


def test_slices_of_the_event_log_have_files_as_their_rows_need_and_are_batches(spark, folder, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 500)
    n, few = 6000, 3
    events_of(spark, folder, n)
    gap = spark.read.parquet(f"{folder}/events.parquet").where(f"event_id < {few}").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 HOURS"))
    gap.withColumn("event_id", F.col("event_id") + n).write.mode("append").parquet(f"{folder}/events.parquet")
    log, files = streams.event_log(spark, folder)
    stream = streams._click_stream(spark, folder, log, files)
    query = stream.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
    query.awaitTermination()
    assert files > 1
    # 6,000 seconds in the first slice, none in the second, three rows at the end: files without rows keep them apart.
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [n, few]
    assert len(spark.read.parquet(log).inputFiles()) == 3 * files
    rows = spark.read.parquet(log).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in rows) < n / 2


def test_copies_are_reduced_where_they_are_read(spark, folder):
    start = dt.datetime(2024, 1, 10)
    rows = [(k % 7 if k % 8 else None, start + dt.timedelta(seconds=k * 37 % 500) if k % 5 else None, k) for k in range(2000)]
    frame = spark.createDataFrame(rows, "k long, at timestamp, n long").coalesce(1)
    kept = ingest.fewer_copies(frame, ["k"], "at").collect()
    first = {}
    for k, _, n in rows:
        first.setdefault(k, n)
    assert set(first.values()) <= {r["n"] for r in kept} and len(kept) <= 16
    for key in first:
        assert max(r["at"] for r in kept if r["k"] == key and r["at"]) == max(at for k, at, _ in rows if k == key and at)


def test_first_arrivals_keep_one_state_row_for_a_key_with_many_copies(spark, folder):
    start = dt.datetime(2024, 1, 10)
    schema = "k long, at timestamp, n long"
    late = start - dt.timedelta(days=9)
    batches = [[(1, start, n) for n in range(500)], [(1, start, 500)], [(2, late, 0), (3, late, 1), (3, start, 2), (1, start, 3), (None, start, 4), (None, start, 5)]]
    for some in batches:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    once = ingest.first_arrivals(source, ["k"], "at", "2 days", spread=["n"])
    writer = once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    # Key 2 came too late; the copy of key 3 that was in time counts, though one too late came before it.
    assert values(spark.read.parquet(f"{folder}/out").select("k", "at"), "k") == [(None, start), (1, start), (3, start)]
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress) == 3


def test_rows_of_an_hour_pass_the_counter_as_one_pack(spark, folder):
    start = dt.datetime(2024, 1, 10, 0, 0, 0, 1)
    rows = [(k if k % 11 else None, f"s{k % 3}" if k % 7 else None, start + dt.timedelta(minutes=k) if k % 5 else None, [k, None], k / 4) for k in range(900)]
    frame = spark.createDataFrame(rows, "id long, site string, at timestamp, more array<long>, x double")
    keyed = frame.withColumn("_hour", F.hour("at").cast("long"))
    packs = stateful.packed(keyed, ["_hour", "site"], frame.columns)
    assert packs.count() == keyed.select("_hour", "site").distinct().count() < 110
    assert packs.agg(F.sum("_n")).first()[0] == len(rows)
    late = packs.select("_hour", "site", F.lit("late").alias("kind"), F.col("_n").alias("visits"), "_pack")
    final = late.limit(1).select("_hour", "site", F.lit("final"), "visits", F.lit(None).cast("binary"))
    out = stateful.unpacked(late.union(final), ["_hour", "site"], frame.schema.fields)
    got = [tuple(r) for r in out.where("kind = 'late'").collect()]
    hours = [(at.hour if at else None, site) for _, site, at, _, _ in rows]
    assert sorted(got, key=repr) == sorted([(*h, "late", 1, *r) for h, r in zip(hours, rows, strict=True)], key=repr)
    (whole,) = out.where("kind = 'final'").collect()
    assert whole["visits"] > 1 and list(whole)[4:] == [None] * 5
