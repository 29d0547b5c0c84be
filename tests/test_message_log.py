"""The stored log as a source, loads into folders, late rows and newest rows over several runs."""

import datetime as dt
import json
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import values
from sediment.operators import reports
from sediment.sources import decode, message_log, messages
from sediment.streaming import ingest, load, stateful

START = dt.datetime(2024, 1, 1)


def put(spark, path, partition, first, n):
    rows = [(None, f"m{partition}-{o}", "t", partition, o, START) for o in range(first, first + n)]
    message_log.write_log(spark.createDataFrame(rows, messages.MESSAGE_SCHEMA), path)


def read_all(spark, folder, start="beginning", most=None, **more):
    got = []
    stream = message_log.stream_log(spark, f"{folder}/log", f"{folder}/positions.json", start, most, **more)

    def keep(batch, number):
        got.extend((number, r["partition"], r["offset"]) for r in batch.collect())

    load.drain(stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).start())
    return got


def test_batches_are_bounded_and_a_restart_goes_on(spark, folder):
    put(spark, f"{folder}/log", 0, 0, 10)
    put(spark, f"{folder}/log", 1, 100, 4)
    got = read_all(spark, folder, most=6, task_rows=2)
    assert sorted((p, o) for _, p, o in got) == [(0, o) for o in range(10)] + [(1, o) for o in range(100, 104)]
    assert {b: sum(x[0] == b for x in got) for b, _, _ in got} == {0: 6, 1: 4, 2: 3, 3: 1}
    put(spark, f"{folder}/log", 0, 10, 2)
    put(spark, f"{folder}/log", 5, 7, 1)  # a partition that came later
    again = read_all(spark, folder, most=6)
    assert sorted((p, o) for _, p, o in again) == [(0, 10), (0, 11), (5, 7)] and min(again)[0] == 4
    assert read_all(spark, folder, most=6) == []


def test_start_at_the_end_or_by_partition(spark, folder):
    put(spark, f"{folder}/log", 0, 0, 5)
    put(spark, f"{folder}/log", 1, 0, 5)
    assert read_all(spark, f"{folder}") and True
    other = f"{folder}/b"
    put(spark, f"{other}/log", 0, 0, 5)
    assert read_all(spark, other, "end") == []
    put(spark, f"{other}/log", 0, 5, 2)
    assert [o for _, _, o in read_all(spark, other, "end")] == [5, 6]
    listed = f"{folder}/c"
    put(spark, f"{listed}/log", 0, 0, 5)
    put(spark, f"{listed}/log", 1, 0, 5)
    assert sorted((p, o) for _, p, o in read_all(spark, listed, {1: 3})) == [(1, 3), (1, 4)]


def test_positions_behind_the_checkpoint_stop_the_stream(spark, folder):
    put(spark, f"{folder}/log", 0, 0, 6)
    read_all(spark, folder)
    with open(f"{folder}/positions.json", "w") as f:
        json.dump({"first": {"0": 0}, "planned": {"0": 2}}, f)
    put(spark, f"{folder}/log", 0, 6, 1)
    stream = message_log.stream_log(spark, f"{folder}/log", f"{folder}/positions.json", "beginning", 1)
    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda b, n: b.collect()).start()
    with pytest.raises(StreamingQueryException, match="behind the checkpoint"):
        load.drain(query)


def test_lag_comes_from_the_log_and_the_positions(spark, folder):
    put(spark, f"{folder}/log", 0, 0, 6)
    put(spark, f"{folder}/log", 1, 0, 3)
    read_all(spark, folder)
    put(spark, f"{folder}/log", 1, 3, 4)
    stored = spark.read.schema(messages.MESSAGE_SCHEMA).parquet(f"{folder}/log")
    read = message_log.committed_offsets(spark, f"{folder}/positions.json", "g", "t")
    assert values(reports.consumer_lag(message_log.end_offsets(stored), read)) == [("g", 4, 2)]


def job(**limits):
    fields = "id BIGINT, d DATE"
    return ingest.LoadJob("job", lambda b: decode.decode_json(b, fields), lambda g: g.withColumnRenamed("d", "event_date"), F.col("id") > 0, **limits)


def batch_of(spark, bodies):
    rows = [(None, b, "t", 0, k, START) for k, b in enumerate(bodies)]
    return spark.createDataFrame(rows, messages.MESSAGE_SCHEMA)


def test_a_batch_is_counted_gated_and_replaced(spark, folder):
    bodies = ['{"id": 1, "d": "2024-01-01"}', '{"id": 0, "d": "2024-01-01"}', "{broken"]
    one = load.PlainLoad(job(max_error_ratio=0.5), folder)
    one.run_batch(batch_of(spark, bodies), 0)
    one.run_batch(batch_of(spark, ['{"id": 5, "d": "2024-01-02"}']), 1)
    one.run_batch(batch_of(spark, bodies), 0)
    assert values(spark.read.parquet(f"{folder}/rows").select("id", "batch_id"), "id") == [(1, 0), (5, 1)]
    counted = spark.read.parquet(f"{folder}/counters").select("batch_id", "total_rows", "loaded_rows", "unselected_rows", "error_rows", "state")
    assert values(counted, "batch_id") == [(0, 3, 1, 1, 1, "RUNNING"), (1, 1, 1, 0, 0, "RUNNING")]
    with pytest.raises(ingest.TooManyErrors):
        load.PlainLoad(job(max_error_ratio=0.1), folder).run_batch(batch_of(spark, bodies), 2)
    assert spark.read.parquet(f"{folder}/rows").where("batch_id = 2").count() == 0
    assert spark.read.parquet(f"{folder}/letters").where("batch_id = 2").count() == 1
    one.run_batch(batch_of(spark, []), 3)
    assert spark.read.parquet(f"{folder}/counters").where("batch_id = 3").select("total_rows").first()[0] == 0


def test_counters_take_no_job_of_their_own(spark, folder):
    """The dead letters' write counts: one write for letters, one for rows, one for the counters' line."""
    tracker, one = spark.sparkContext.statusTracker(), load.PlainLoad(job(max_error_ratio=1.0), folder)
    batch = batch_of(spark, ['{"id": 1, "d": "2024-01-01"}', "{broken"])
    spark.sparkContext.setJobGroup("counted", "")
    one.run_batch(batch, 0)
    with_counters = len(tracker.getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("plain", "")
    decoded = job().decode(batch).persist()
    load.write_partitions(decoded.where("_error IS NOT NULL").withColumn("batch_id", F.lit(0)), f"{folder}/a", ["batch_id"])
    load.write_partitions(decoded.where("_error IS NULL").withColumn("batch_id", F.lit(0)), f"{folder}/b", ["batch_id"])
    load.write_partitions(spark.createDataFrame([(1, 2)], "x int, batch_id int"), f"{folder}/c", ["batch_id"])
    decoded.unpersist()
    plain = len(tracker.getJobIdsForGroup("plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert with_counters <= plain


def test_progress_outlives_what_spark_remembers(spark, folder):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    progress = load.ProgressLog(spark, f"{folder}/progress", every=4)
    spark.streams.addListener(progress)
    try:
        for k in range(12):
            put(spark, f"{folder}/log", 0, k, 1)
        stream = message_log.stream_log(spark, f"{folder}/log", f"{folder}/positions.json", "beginning", 1)
        writer = stream.writeStream.queryName("many").option("checkpointLocation", f"{folder}/checkpoint")
        query = writer.format("noop").start()
        query.processAllAvailable()
        assert len(query.recentProgress) <= 3
        query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(progress)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        progress.flush()
    assert values(load.job_status(spark.read.parquet(f"{folder}/progress")).select("job_name", "batches", "input_rows", "last_batch")) == [("many", 12, 12, 11)]


def clicks(spark, folder, minutes):
    rows = [(k, START + dt.timedelta(minutes=m) if m is not None else None) for k, m in minutes]
    spark.createDataFrame(rows, "id long, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(1.1)  # files are read in the order of their times


def test_late_rows_are_handed_out_and_state_ends(spark, folder):
    batches = [[(k, k) for k in range(0, 300, 10)], [(1000 + k, 300 + k) for k in range(0, 300, 10)], [(2000, 5), (2001, 301), (2002, 599), (2003, None)], [(3000, 5000)]]
    for some in batches:
        clicks(spark, folder, some)
    source = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    found = stateful.counts_and_late_rows(source, "at", spread="id", salts=3)
    writer = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{folder}/out")
    late = values(out.where("kind = 'late'").select("row_id", "row_at"), "row_id")
    assert [i for i, _ in late] == [2000, 2001, 2003] and late[0][1] == START + dt.timedelta(minutes=5)
    counts = out.where("kind = 'final'").groupBy("hour").agg(F.sum("visits").alias("n"))
    expected = {}
    for k, m in [x for some in batches[:2] for x in some] + [(2002, 599)]:
        expected[m // 60] = expected.get(m // 60, 0) + 1
    assert {int((h - START).total_seconds() // 3600): n for h, n in values(counts)} == expected
    state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    # A count and a timer for each of three parts of the hours that are not over: five and a half at most.
    assert max(state) <= 2 * 3 * 7 and state[-1] <= 2


def test_newest_rows_over_batches_and_a_restart(spark, folder):
    schema = "k long, v string, at long"
    runs = [[[(1, "a", 5), (1, "b", 3), (2, "x", 1), (None, "n", 1)], [(1, "c", 4), (2, "y", 2)]], [[(1, "d", 6), (1, "e", None), (2, "z", 2), (None, "m", 9)]]]
    emitted = []
    for run in runs:
        for some in run:
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            time.sleep(1.1)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
        changes = stateful.newest_rows(source, ["k"], ["at"])

        def keep(batch, number):
            emitted.extend((number, *r) for r in batch.collect())

        writer = changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
        writer.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert sorted(emitted, key=repr) == sorted([(0, 1, "a", 5), (0, 2, "x", 1), (0, None, "n", 1), (1, 2, "y", 2), (2, 1, "d", 6), (2, None, "m", 9)], key=repr)


def test_keys_are_forgotten_after_their_time(spark, folder):
    schema = "k long, at long"
    spark.createDataFrame([(1, 9)], schema).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(schema).parquet(f"{folder}/in")
    got = []
    writer = stateful.newest_rows(source, ["k"], ["at"], keep="2 seconds").writeStream.outputMode("update")
    query = writer.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).trigger(processingTime="1 second").start()
    try:
        ends = time.time() + 60
        while not got and time.time() < ends:
            time.sleep(0.2)
        while time.time() < ends and query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0:
            time.sleep(0.3)
        spark.createDataFrame([(1, 3)], schema).write.mode("append").parquet(f"{folder}/in")
        while len(got) < 2 and time.time() < ends:
            time.sleep(0.2)
    finally:
        query.stop()
    assert got == [(1, 9), (1, 3)]
