import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import values
from sediment.operators import layout, reports
from sediment.sources import files, messages
from sediment.sources.day_table import DayTable

ROWS = [
    "71,9,2024-08-02,2024-12-31,2024-08-02 23:10:05,left the harbour",
    "72,11,2024-08-02,2024-12-31,2024-08-02 23:40:00,seen at the lock",
    "73,9,2024-08-02,2024-12-31,2024-08-02 23:59:59,tied up",
]
SCHEMA = "event_id BIGINT, user_id BIGINT, event_date DATE, eviction_date DATE, event_ts TIMESTAMP, payload STRING"


def put(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def loader(spark, table):
    return lambda paths: table.upsert(files.read_files(spark, paths, "csv", SCHEMA), ["event_ts"])


def test_same_file_loads_once_and_new_ones_follow(spark, folder):
    put(f"{folder}/in/a.csv", ROWS)
    table = DayTable(spark, f"{folder}/t", SCHEMA, ["event_id"])
    load = loader(spark, table)
    assert files.load_new_files(spark, f"{folder}/in", f"{folder}/ledger", load) == 1
    assert files.load_new_files(spark, f"{folder}/in", f"{folder}/ledger", load) == 0
    assert table.read().count() == 3
    for n in range(3):
        put(f"{folder}/in/deep/er/{n}.csv", [ROWS[0].replace("71,", f"{80 + n},", 1)])
    assert files.load_new_files(spark, f"{folder}/in", f"{folder}/ledger", load, per_commit=2) == 3
    assert table.read().count() == 6


def test_failed_file_is_recorded_and_retried_by_name(spark, folder):
    put(f"{folder}/in/a.csv", ROWS)

    def fails(paths):
        raise RuntimeError("cannot read")

    assert files.load_new_files(spark, f"{folder}/in", f"{folder}/ledger", fails) == 0
    states = files.current_file_states(files.read_ledger(spark, f"{folder}/ledger"))
    failed = files.failed_files(states)
    assert failed.count() == 1
    name = failed.first()["path"]
    table = DayTable(spark, f"{folder}/t", SCHEMA, ["event_id"])
    assert files.load_new_files(spark, f"{folder}/in", f"{folder}/ledger", loader(spark, table), only=[name]) == 1
    states = files.current_file_states(files.read_ledger(spark, f"{folder}/ledger"))
    assert files.failed_files(states).count() == 0


def test_forgotten_after_seven_days(spark):
    now = F.lit("2024-01-20").cast("timestamp")
    ledger = spark.createDataFrame(
        [("old", "LOADED", dt.datetime(2024, 1, 12)), ("edge", "LOADED", dt.datetime(2024, 1, 13)), ("bad", "ERROR", dt.datetime(2024, 1, 19))],
        "path string, state string, loaded_at timestamp",
    )
    listing = ledger.select("path").union(spark.createDataFrame([("new",)], "path string"))
    assert values(files.files_to_load(listing, ledger), "path") == [("bad",), ("new",)]
    assert values(files.files_to_load(listing, ledger, now, 7), "path") == [("bad",), ("new",), ("old",)]
    full = ledger.selectExpr("*", "CAST(NULL AS TIMESTAMP) AS last_modified", "CAST(NULL AS STRING) AS error")
    assert values(files.files_to_load(listing, full, now, 7, retry_errors=False), "path") == [("new",), ("old",)]


def test_file_stream_reads_every_file_once(spark, folder):
    put(f"{folder}/in/a.csv", ROWS)
    put(f"{folder}/in/sub/b.csv", [ROWS[0].replace("71,", "93,", 1)])
    put(f"{folder}/in/skip.txt", ["nothing"])
    for expected in (4, 4):
        stream = files.file_stream(spark, f"{folder}/in", "csv", SCHEMA, max_files=1, glob="*.csv")
        query = (
            stream.writeStream.format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        out = spark.read.parquet(f"{folder}/out")
        assert out.count() == expected
        assert out.select("_file").distinct().count() == 2


def test_json_files_with_an_outer_array_and_own_line_ends(spark, folder):
    put(f"{folder}/a.json", ['[{"a": 1},', ' {"a": 2}]'])
    assert values(files.read_files(spark, [f"{folder}/a.json"], "json", "a INT", outer_array=True), "a") == [(1,), (2,)]
    put(f"{folder}/b.csv", ["a;b|1;'x;y'|2;z"])
    got = files.read_files(spark, [f"{folder}/b.csv"], "csv", "a INT, b STRING", header=True, separator=";", quote="'", line_separator="|")
    assert [r for r in values(got.where("a IS NOT NULL"), "a")] == [(1, "x;y"), (2, "z\n")]


def test_kafka_options():
    got = messages.kafka_options("a:1,b:2", "events", {0: 5, 1: -2}, max_rows=500_000, min_partitions=6)
    assert got["startingOffsets"] == '{"events": {"0": 5, "1": -2}}'
    assert got["maxOffsetsPerTrigger"] == "500000" and got["minPartitions"] == "6"
    assert messages.kafka_options("a:1", "t")["startingOffsets"] == "latest"
    assert messages.kafka_options("a:1", "t", "beginning")["startingOffsets"] == "earliest"
    assert messages.trigger_options(10) == {"processingTime": "10 seconds"}


def test_publish_csv_rows_without_header(spark, folder):
    put(f"{folder}/crash.csv", ["id,place", '1,"A, B"', "2,C"])
    rows = spark.read.csv(f"{folder}/crash.csv", header=True)
    sent = messages.publish_rows(rows, "crash", F.col("id"), F.col("id") % 3, as_csv=True)
    assert values(sent.select("value", "partition", "offset"), "offset") == [('1,"A, B"', 1, 1), ("2,C", 2, 2)]


def test_generated_clicks_follow_the_weights(spark):
    made = messages.click_messages(spark.range(40_000), "id", F.lit(1_700_000_000)).persist()
    share = {r["site"]: r["count"] / 40_000 for r in made.groupBy("site").count().collect()}
    expected = {"https://www.example.org/": 0.498, "https://docs.example.org/": 0.274, "https://www.example.org/blog": 0.169, "https://www.example.org/community": 0.060}
    for site, weight in expected.items():
        assert share[site] == pytest.approx(weight, abs=0.01)
    span = made.agg(F.min("uid"), F.max("uid"), F.min("late_seconds"), F.max("late_seconds")).first()
    assert span[0] >= 1 and span[1] <= 10_000 and span[2] == 0 and 4000 < span[3] <= 5400
    made.unpersist()


def test_table_lifecycle(spark, folder):
    layout.ensure_table(spark, "lifecycle", "a INT, day DATE", f"{folder}/t", ["day"])
    layout.ensure_table(spark, "lifecycle", "a INT, day DATE", f"{folder}/t", ["day"])
    spark.sql("INSERT INTO lifecycle VALUES (1, DATE '2024-01-01')")
    spark.createDataFrame([(2,)], "a int").withColumn("day", F.lit("2024-01-02").cast("date")).write.insertInto("lifecycle")
    assert spark.table("lifecycle").count() == 2
    assert values(reports.table_row_counts({"x": spark.table("lifecycle")})) == [("x", 2)]
    layout.drop_table(spark, "lifecycle")
    layout.drop_table(spark, "lifecycle")
    assert not spark.catalog.tableExists("lifecycle")


def test_one_bad_file_does_not_keep_the_others_out(spark, folder):
    for n in range(3):
        put(f"{folder}/in/{n}.csv", [ROWS[0].replace("71,", f"{80 + n},", 1)])
    table, long_text = DayTable(spark, f"{folder}/t", SCHEMA, ["event_id"]), "x" * 10_000

    def load(paths):
        if any(p.endswith("1.csv") for p in paths):
            raise RuntimeError(long_text)
        loader(spark, table)(paths)

    ledger = f"{folder}/ledger"
    assert files.load_new_files(spark, f"{folder}/in", ledger, load) == 2
    states = {r["path"][-5:]: r for r in files.current_file_states(files.read_ledger(spark, ledger)).collect()}
    assert {k: r["state"] for k, r in states.items()} == {"0.csv": "LOADED", "1.csv": "ERROR", "2.csv": "LOADED"}
    assert states["1.csv"]["error"] == long_text
    assert files.read_ledger(spark, ledger).where("state = 'LOADING'").count() == 3
    assert files.load_new_files(spark, f"{folder}/in", ledger, loader(spark, table)) == 0
    assert files.load_new_files(spark, f"{folder}/in", ledger, loader(spark, table), only=[states["1.csv"]["path"]]) == 1
    assert table.read().count() == 3


def test_stream_reads_a_file_that_is_older_than_a_week(spark, folder):
    def drain():
        stream = files.file_stream(spark, f"{folder}/in", "csv", SCHEMA)
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
        query.trigger(availableNow=True).start().awaitTermination()

    put(f"{folder}/in/new.csv", ROWS[:1])
    drain()
    put(f"{folder}/in/old.csv", ROWS[1:2])
    past = dt.datetime.now().timestamp() - 10 * 86_400
    os.utime(f"{folder}/in/old.csv", (past, past))
    drain()
    assert spark.read.parquet(f"{folder}/out").count() == 2
