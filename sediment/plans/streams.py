"""Streaming jobs run over the tables to their end, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import times
from sediment.plans import inputs
from sediment.plans.registry import query
from sediment.plans.tables import STORED, by_day
from sediment.session import scratch_path
from sediment.sources import messages
from sediment.sources.day_table import DayTable
from sediment.sources.decode import decode_json
from sediment.sources.files import ANY_AGE
from sediment.streaming import ingest, stateful

FILE_ROWS = 250_000
MESSAGE_FIELDS = "event_id BIGINT, user_id BIGINT, event_ts BIGINT, eviction_date DATE, cents BIGINT"


def _decode(batch: DataFrame) -> DataFrame:
    return decode_json(batch, MESSAGE_FIELDS)


def _to_rows(good: DataFrame) -> DataFrame:
    return good.withColumn("event_date", times.day_from_millis(F.col("event_ts")))


def _run(query) -> None:
    query.awaitTermination()
    problem = query.exception()
    if problem is not None:
        raise problem


def message_log(spark: SparkSession, folder: str) -> str:
    """Events, a second delivery of every seventh, and one broken message in fifty, as a stored log."""
    events = inputs.canonical_events(spark, folder)
    moved = inputs.replays(events).withColumn("event_ts", F.col("event_ts") + 86_400_000)
    sent = inputs.messages(events).unionByName(
        inputs.messages(moved).withColumn("offset", F.col("offset") + 1_000_000_000)
    )
    broken = F.expr("substring(value, 1, length(value) - 1)")
    value = F.when((F.col("offset") % 50 == 0) & (F.col("offset") < 1_000_000_000), broken).otherwise(F.col("value"))
    path = scratch_path(spark, "log")
    # All messages of a key lie in one file, so that no batch brings an older one than a batch before it.
    sent.withColumn("value", value).repartition(log_files(events.count()), "partition", "key").write.parquet(path)
    return path


def log_files(rows: int) -> int:
    """Files of a log of so many rows: an even number of files of about ``FILE_ROWS``."""
    return max(4, 2 * -(-rows // (2 * FILE_ROWS)))


@query
def stream_equals_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Messages through the ingest job into the upsert table: rows per day, and dead letters."""
    root = scratch_path(spark, "stream")
    table = DayTable(spark, f"{root}/events", STORED, ["event_id"], sort=["user_id"], mode="read")
    letters = DayTable(spark, f"{root}/letters", ingest.DEAD_LETTER_SCHEMA, day="captured_on")
    job = ingest.LoadJob("load_events", _decode, _to_rows, F.col("user_id") > 0).with_limits(10**9, 0.05)
    load = ingest.Ingest(job, table, letters, f"{root}/checkpoint")
    log = message_log(spark, folder)
    half = max(2, -(-len(spark.read.parquet(log).inputFiles()) // 2))
    _run(load.start(messages.replay_messages(spark, log, max_files=half)))
    table.fold()
    stored = by_day(table.read()).withColumn("kind", F.lit("stored"))
    bad = letters.read().groupBy(F.col("captured_on").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("source_offset").alias("total_cents")
    )
    return stored.unionByName(bad.withColumn("kind", F.lit("dead letters")))


SLICES = 3


def slice_files(rows: int) -> int:
    """Files of each slice of a log of so many rows: about ``FILE_ROWS`` in a file, one at least."""
    return max(1, -(-rows // (SLICES * FILE_ROWS)))


def event_log(spark: SparkSession, folder: str) -> tuple[str, int]:
    """Events in slices that come one after the other in time, as a topic delivers them, and files of a slice.

    All slices have the same number of files, so a stream that takes so many at a time takes one slice.
    """
    events, path = inputs.table(spark, folder, "events"), scratch_path(spark, "event-log")
    first, last, rows = events.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    files = slice_files(rows)
    if first is None:
        events.write.parquet(path)
        return path, files
    bounds = [first + (last - first) * k / SLICES for k in range(1, SLICES)]
    number = sum((F.when(F.col("ts") >= F.lit(b).cast(events.schema["ts"].dataType), 1).otherwise(0) for b in bounds), F.lit(0))
    for k in range(SLICES):
        events.where(number == k).repartition(files).write.mode("append").parquet(path)
        # A slice of few rows has fewer files than asked for: files without rows make up for them.
        for _ in range((k + 1) * files - len(spark.read.parquet(path).inputFiles())):
            events.limit(0).write.mode("append").parquet(path)
    return path, files


def _past_the_end(spark: SparkSession, folder: str, log: str) -> None:
    """One event two days after the last: it moves the watermark past all hours before it."""
    events = inputs.table(spark, folder, "events")
    mark = events.orderBy(F.desc("ts"), "event_id").limit(1)
    later = (F.col("ts") + F.expr("INTERVAL 2 DAYS")).cast(events.schema["ts"].dataType)
    mark.withColumns({"event_id": F.lit(-1).cast("bigint"), "ts": later}).write.mode("append").parquet(log)


def _click_stream(spark: SparkSession, folder: str, log: str, files: int) -> DataFrame:
    reader = spark.readStream.schema(inputs.table(spark, folder, "events").schema)
    source = reader.option("maxFilesPerTrigger", str(files)).option("maxFileAge", ANY_AGE).parquet(log)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    made = messages.click_messages(source, "event_id", seconds)
    return made.withColumn("visited_at", F.timestamp_seconds("vtime"))


def _collect_stream(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Run to the end of what there is, or go on from there, and return all that was written so far."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
    _run(writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


@query
def stream_hourly_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Hours that the watermark, 90 minutes behind the newest click, has passed; their state is gone.

    Clicks are up to 90 minutes late, so none is lost while the log comes in the order of time.
    """
    log, files = event_log(spark, folder)
    _past_the_end(spark, folder, log)
    hours = ingest.hourly_counts(_click_stream(spark, folder, log, files), "visited_at", ["site"])
    kept = _collect_stream(spark, hours, scratch_path(spark, "hourly"))
    return kept.select(times.timestamp_text(F.col("hour")).alias("hour"), "site", "visits")


@query
def stream_late_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a log in no order of time: what comes after its hour has ended is kept aside as late rows.

    Final counts and late rows add up to the counts of a batch, whichever rows were late.
    """
    log, root = scratch_path(spark, "mixed-log"), scratch_path(spark, "late")
    events = inputs.table(spark, folder, "events")
    files = slice_files(events.count())
    events.repartition(SLICES * files, F.xxhash64("event_id")).write.parquet(log)
    kept = None
    for run in (1, 2):
        clicks = _click_stream(spark, folder, log, files).select("event_id", "site", "visited_at")
        found = stateful.counts_and_late_rows(clicks, "visited_at", ["site"])
        kept = _collect_stream(spark, found, root)
        if run == 1:
            _past_the_end(spark, folder, log)
    return kept.groupBy(times.timestamp_text(F.col("hour")).alias("hour"), "site").agg(F.sum("visits").alias("visits"))


@query
def stream_first_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The click stream unioned with itself; the repeats are dropped. Keys are remembered for two days."""
    log, files = event_log(spark, folder)
    copies = [_click_stream(spark, folder, log, files).withColumn("copy", F.lit(n)) for n in (1, 2)]
    once = ingest.first_arrivals(
        copies[0].unionByName(copies[1]), ["event_id"], "visited_at", "2 days", spread=["event_id", "copy"]
    )
    kept = _collect_stream(spark, once, scratch_path(spark, "first"))
    return kept.groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("sum_ids"))
