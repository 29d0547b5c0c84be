import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import values
from sediment.functions import times
from sediment.operators import dedup, reports
from sediment.plans.tables import STORED
from sediment.sources import decode, files, messages
from sediment.sources.day_table import DayTable
from sediment.streaming import ingest

FIELDS = "event_id BIGINT, user_id BIGINT, event_ts BIGINT, eviction_date DATE, cents BIGINT"
DAY = 1_704_067_200_000


def body(event_id, user=1, ms=DAY, cents=0):
    return f'{{"event_id": {event_id}, "user_id": {user}, "event_ts": {ms}, "eviction_date": "2024-04-01", "cents": {cents}}}'


def put(spark, path, bodies, first=0):
    rows = [(None, b, "events", 0, first + i, dt.datetime(2024, 1, 1)) for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, messages.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load(spark, folder, mode="write", **limits):
    job = ingest.LoadJob(
        "job",
        lambda b: decode.decode_json(b, FIELDS),
        lambda g: g.withColumn("event_date", times.day_from_millis(F.col("event_ts"))),
        F.col("user_id") > 0,
        **limits,
    )
    return ingest.Ingest(
        job,
        DayTable(spark, f"{folder}/events", STORED, ["event_id"], mode=mode),
        DayTable(spark, f"{folder}/letters", ingest.DEAD_LETTER_SCHEMA, day="captured_on"),
        f"{folder}/checkpoint",
        DayTable(spark, f"{folder}/status", ingest.STATUS_SCHEMA, day="checked_on"),
    )


def drain(spark, folder, job):
    query = job.start(messages.replay_messages(spark, f"{folder}/log"))
    query.awaitTermination()
    return query


@pytest.mark.parametrize("mode", ["write", "read"])
def test_good_bad_unselected_and_resume(spark, folder, mode):
    put(spark, f"{folder}/log", [body(1, cents=5), body(2, user=0), "{broken"])
    job = load(spark, folder, mode, max_error_ratio=0.5)
    drain(spark, folder, job)
    put(spark, f"{folder}/log", [body(1, ms=DAY + 86_400_000, cents=6), body(3)], first=3)
    drain(spark, folder, job)
    got = values(job.table.read().select("event_id", "event_date", "cents"), "event_id")
    assert got == [(1, dt.date(2024, 1, 2), 6), (3, dt.date(2024, 1, 1), 0)]
    assert values(job.letters.read().select("source_offset", "raw_message")) == [(2, "{broken")]
    counts = values(job.status.read().select("batch_id", "total_rows", "loaded_rows", "unselected_rows", "error_rows"), "batch_id")
    assert counts == [(0, 3, 1, 1, 1), (1, 2, 2, 0, 0)]


def test_batch_run_again_changes_nothing(spark, folder):
    put(spark, f"{folder}/log", [body(1), "{broken"])
    job = load(spark, folder, max_error_ratio=0.5)
    batch = messages.stored_messages(spark, f"{folder}/log")
    job.run_batch(batch, 4)
    states = job.table.state(), job.letters.state()
    job.run_batch(batch, 4)
    assert (job.table.state(), job.letters.state()) == states


def test_crash_after_dead_letters_finishes_on_the_second_run(spark, folder, monkeypatch):
    put(spark, f"{folder}/log", [body(1), "{broken"])
    job = load(spark, folder, max_error_ratio=0.5)
    batch = messages.stored_messages(spark, f"{folder}/log")

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(DayTable, "upsert", dies)
        with pytest.raises(RuntimeError):
            job.run_batch(batch, 0)
    assert job.letters.read().count() == 1 and job.table.read().count() == 0
    job.run_batch(batch, 0)
    assert job.letters.read().count() == 1 and job.table.read().count() == 1


def test_error_gate_holds_the_batch_until_the_limit_is_raised(spark, folder):
    put(spark, f"{folder}/log", [body(i) for i in range(50)] + ["{broken"])
    job = load(spark, folder)
    with pytest.raises(Exception, match="1 of 51 rows are in error"):
        drain(spark, folder, job)
    assert job.table.read().count() == 0 and job.letters.read().count() == 0
    job.job = job.job.with_limits(10, 0.05)
    drain(spark, folder, job)
    assert job.table.read().count() == 50 and job.letters.read().count() == 1


def test_interval_change_and_stop(spark, folder):
    put(spark, f"{folder}/log", [body(1)])
    job = load(spark, folder)
    source = messages.replay_messages(spark, f"{folder}/log")
    query = job.start(source, processingTime="1 seconds")
    query.processAllAvailable()
    put(spark, f"{folder}/log", [body(2)], first=1)
    query = job.alter(source, 2)
    query.processAllAvailable()
    job.stop()
    assert not query.isActive
    assert job.table.read().count() == 2
    assert ingest.progress_rows(spark, query).agg(F.sum("input_rows")).first()[0] == 1


def test_content_sent_twice_is_skipped_by_the_ledger(spark, folder):
    put(spark, f"{folder}/log", [body(1), body(2)])
    put(spark, f"{folder}/again", [body(2), body(1)], first=50)
    job = load(spark, folder)
    job.table = DayTable(spark, f"{folder}/plain", STORED)
    job.ledger = DayTable(spark, f"{folder}/ledger", dedup.LEDGER_SCHEMA, day="accepted_on")
    for number, path in enumerate(["log", "again"]):
        job.run_batch(messages.stored_messages(spark, f"{folder}/{path}"), number)
    assert job.table.read().count() == 2 and job.ledger.read().count() == 1


def test_files_and_topic_feed_one_table(spark, folder):
    put(spark, f"{folder}/log", [body(1), body(2)])
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.json", "w") as f:
        f.write(body(2, cents=7) + "\n" + body(4) + "\n")
    from_files = files.as_messages(files.file_stream(spark, f"{folder}/in", "json", FIELDS), sequence="event_id")
    job = load(spark, folder)
    job.start(ingest.one_stream(messages.replay_messages(spark, f"{folder}/log"), from_files)).awaitTermination()
    assert values(job.table.read().select("event_id", "cents"), "event_id") == [(1, 0), (2, 7), (4, 0)]


def test_deltas_are_merged_after_some_batches(spark, folder):
    job = load(spark, folder, "read")
    job.fold_after = 2
    for n in range(3):
        put(spark, f"{folder}/log{n}", [body(1, cents=n), body(10 + n)], first=10 * n)
        job.run_batch(messages.stored_messages(spark, f"{folder}/log{n}"), n)
        assert len(job.table.state()["deltas"]) == (n + 1) % 2
    assert values(job.table.read().select("event_id", "cents"), "event_id") == [(1, 2), (10, 0), (11, 0), (12, 0)]


def test_small_folders_of_appended_tables_are_merged(spark, folder):
    job = load(spark, folder, max_error_ratio=1.0)
    job.table = DayTable(spark, f"{folder}/plain", STORED)
    job.fold_after = 3
    for n in range(4):
        put(spark, f"{folder}/log{n}", [body(n), "{broken"], first=10 * n)
        job.run_batch(messages.stored_messages(spark, f"{folder}/log{n}"), n)
    for sink in (job.table, job.letters, job.status):
        assert sink.most_segments() == 2 and sink.read().count() == 4


def test_lag_from_kafka_progress(spark):
    progress = {"sources": [{"endOffset": {"events": {"0": 5, "1": 7}}, "latestOffset": '{"events": {"0": 9, "1": 7, "2": 3}}'}]}
    ends, read = ingest.kafka_offsets(spark, "g", progress)
    assert values(reports.consumer_lag(ends, read)) == [("g", 7, 3)]


def test_live_clicks(spark, folder):
    query = (
        messages.live_clicks(spark, 50).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/cp").trigger(processingTime="1 seconds").start()
    )
    deadline = time.time() + 30
    while time.time() < deadline and sum(p["numInputRows"] for p in query.recentProgress) < 50:
        time.sleep(0.5)
    query.stop()
    clicks = spark.read.parquet(f"{folder}/out")
    assert clicks.count() >= 50 and clicks.where("uid NOT BETWEEN 1 AND 10000").count() == 0


def test_topic_and_files_as_one_stream(spark, folder):
    put(spark, f"{folder}/log", [body(1), body(2)])
    put(spark, f"{folder}/log2", [body(2, cents=9), body(3)], first=100)
    both = ingest.one_stream(*[messages.replay_messages(spark, f"{folder}/{p}") for p in ("log", "log2")])
    job = load(spark, folder)
    job.start(both).awaitTermination()
    assert values(job.table.read().select("event_id", "cents"), "event_id") == [(1, 0), (2, 9), (3, 0)]


def test_clicks_89_minutes_late_count_and_91_do_not(spark, folder):
    schema = "id INT, at TIMESTAMP"
    base = dt.datetime(2024, 1, 1, 12, 0)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        clicks = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = (
            ingest.hourly_counts(clicks, "at").writeStream.outputMode("append").format("parquet")
            .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return {r["hour"].hour: r["visits"] for r in spark.read.parquet(f"{folder}/out").collect()}

    run([(1, base)])
    run([(2, base - dt.timedelta(minutes=59)), (3, base - dt.timedelta(minutes=89)), (4, base - dt.timedelta(minutes=121))])
    got = run([(5, base + dt.timedelta(hours=5))])
    # The hour from 10:00 still counts the click that is 89 minutes late; 9:59 was already final.
    assert got[10] == 1 and got[11] == 1 and 9 not in got


def test_first_arrival_is_kept(spark, folder):
    schema = "k INT, at TIMESTAMP, n INT"
    rows = [(1, dt.datetime(2024, 1, 1), i) for i in range(100)] + [(2, dt.datetime(2024, 1, 1), 0)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/in")
    stream = ingest.first_arrivals(spark.readStream.schema(schema).parquet(f"{folder}/in"), ["k"], "at", spread=["n"], salts=4)
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert values(spark.read.parquet(f"{folder}/out").groupBy("k").count(), "k") == [(1, 1), (2, 1)]


def test_long_bad_message_comes_back_whole(spark, folder):
    bad = "{" + "x" * 100_000
    put(spark, f"{folder}/log", [body(1), bad])
    job = load(spark, folder, max_error_ratio=0.5)
    drain(spark, folder, job)
    assert job.letters.read().first()["raw_message"] == bad


def test_days_outside_the_window_become_dead_letters(spark, folder):
    now = int(dt.datetime.now(dt.UTC).timestamp() * 1000)
    put(spark, f"{folder}/log", [body(1, ms=now), body(2, ms=DAY), body(3, ms=now + 400 * 86_400_000)])
    job = load(spark, folder)
    job.window = (90, 3)
    drain(spark, folder, job)
    assert values(job.table.read().select("event_id")) == [(1,)]
    assert {r["error_message"] for r in job.letters.read().collect()} == {"day outside the window"}
    assert job.letters.read().count() == 2


def test_status_says_running_or_paused(spark, folder):
    put(spark, f"{folder}/log", [body(1), body(2)])
    job = load(spark, folder)
    drain(spark, folder, job)
    put(spark, f"{folder}/log", ["{", "{"], first=2)
    with pytest.raises(Exception, match="rows are in error"):
        drain(spark, folder, job)
    lines = job.status.read().orderBy("batch_id").collect()
    assert [r["state"] for r in lines] == ["RUNNING", "PAUSED"] and lines[0]["rows_per_second"] > 0
