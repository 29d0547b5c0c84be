"""Micro-batch ingest: decode, check, write dead letters, upsert, count.

The source delivers a batch at least once; each sink remembers the number of the last batch it took
from a job, so a batch that is run again after a failure changes nothing twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sediment.operators import dedup, layout
from sediment.sources.day_table import DayTable
from sediment.sources.decode import load_counters, split_good_bad
from sediment.streaming.stateful import keep_state_in_rocksdb

# Columns of the dead-letter table.
DEAD_LETTER_SCHEMA = (
    "captured_on DATE, captured_at TIMESTAMP, job_name STRING, task_id STRING, source_partition INT, "
    "source_offset BIGINT, raw_message STRING, error_message STRING"
)
STATUS_SCHEMA = (
    "checked_on DATE, job_name STRING, batch_id BIGINT, total_rows BIGINT, loaded_rows BIGINT, "
    "unselected_rows BIGINT, error_rows BIGINT, checked_at TIMESTAMP, state STRING, rows_per_second DOUBLE"
)
ARRIVAL = ("timestamp", "offset", "partition")


class TooManyErrors(RuntimeError):
    """The batch was not written. It runs again when the job is started again."""


@dataclass(frozen=True)
class LoadJob:
    """What to do with the messages of one source."""

    name: str
    decode: Callable[[DataFrame], DataFrame]
    to_rows: Callable[[DataFrame], DataFrame]
    where: Column | None = None
    arrival: Sequence[str] = ARRIVAL
    max_errors: int = 1_000
    max_error_ratio: float = 0.01

    def with_limits(self, max_errors: int, max_error_ratio: float) -> LoadJob:
        """The same job with other limits, to get past a batch that is known to be bad."""
        return replace(self, max_errors=max_errors, max_error_ratio=max_error_ratio)


def check_errors(job: LoadJob, total: int, errors: int) -> None:
    if errors > job.max_errors or errors > job.max_error_ratio * total:
        raise TooManyErrors(f"{job.name}: {errors} of {total} rows are in error")


def dead_letters(bad: DataFrame, job_name: str, task: str) -> DataFrame:
    """Rows for the dead-letter table, captured at the time of the message."""
    at = F.coalesce("timestamp", F.current_timestamp())
    return bad.select(
        F.to_date(at).alias("captured_on"),
        at.alias("captured_at"),
        F.lit(job_name).alias("job_name"),
        F.lit(task).alias("task_id"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.col("value").alias("raw_message"),
        F.col("_error").alias("error_message"),
    )


@dataclass
class Ingest:
    """A load job with its sinks. ``start`` can be called again after ``stop`` or a failure.

    With an upsert table in ``read`` mode, the deltas are merged after every ``fold_after`` batches; in
    a table that is appended to, the small files of a day are merged when it has that many folders.
    With a ``ledger``, a batch whose content equals one of the last seven days is skipped, whatever its
    number; an append-only table needs this against messages sent twice. With a ``window``, (days back,
    days ahead) of the current date, rows of other days become dead letters. The ``status`` table has a
    line for every batch, RUNNING with its rate, or PAUSED if it had too many errors. Superseded
    folders are removed after every ``fold_after`` batches once they are ``keep_seconds`` old.
    """

    def _fingerprint(self, batch: DataFrame) -> DataFrame:
        content = [c for c in ("key", "value", "topic") if c in batch.columns]
        return dedup.batch_fingerprints(batch, [], content).withColumn("accepted_at", F.current_timestamp())

    job: LoadJob
    table: DayTable
    letters: DayTable
    checkpoint: str
    status: DayTable | None = None
    ledger: DayTable | None = None
    fold_after: int = 100
    small_bytes: int = 128 * 1024 * 1024
    window: tuple[int, int] | None = None
    keep_seconds: float = 24 * 3600
    query: StreamingQuery | None = field(default=None, repr=False)

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table, letters = self.table.with_session(spark), self.letters.with_session(spark)
        token = (self.job.name, batch_id)
        ledger = self.ledger.with_session(spark) if self.ledger is not None else None
        began = time.monotonic()
        if ledger is not None and not ledger.already_done(token):
            entry = self._fingerprint(batch)
            live = dedup.live_ledger(ledger.read(), F.current_timestamp())
            if dedup.unseen_batches(entry, live, ["accepted_at"]).isEmpty():
                return
        selected = self.job.where if self.job.where is not None else F.lit(True)
        decoded = self.job.decode(batch).persist()
        try:
            counts = load_counters(decoded, selected).first()
            total, errors = (counts["total_rows"], counts["error_rows"]) if counts else (0, 0)
            if total == 0:
                return
            try:
                check_errors(self.job, total, errors)
            except TooManyErrors:
                self._report(spark, batch_id, counts, "PAUSED", began, None)
                raise
            good, bad = split_good_bad(decoded)
            rows = self.job.to_rows(good.where(selected))
            refused = dead_letters(bad, self.job.name, str(batch_id)) if errors else None
            if self.window is not None:
                stray = F.coalesce(layout.outside_window(F.col(table.day), F.current_date(), *self.window), F.lit(True))
                far = rows.where(stray).withColumn("_error", F.lit("day outside the window"))
                far = dead_letters(far, self.job.name, str(batch_id))
                refused = far if refused is None else refused.unionByName(far)
                rows = rows.where(~stray)
            if refused is not None and not letters.already_done(token) and not refused.isEmpty():
                letters.append(refused, token)
            if table.key:
                table.upsert(rows, self.job.arrival, token)
                if len(table.state()["deltas"]) >= self.fold_after:
                    table.fold()
            else:
                table.append(rows, token)
            if ledger is not None:
                if not ledger.already_done(token):
                    ledger.append(entry.withColumn("accepted_on", F.to_date("accepted_at")), token)
                self._tidy(ledger)
            self._report(spark, batch_id, counts, "RUNNING", began, token)
            for sink in (table, letters):
                self._tidy(sink)
        finally:
            decoded.unpersist()

    def _report(self, spark: SparkSession, batch_id: int, counts, state: str, began: float, token) -> None:
        if self.status is None:
            return
        rate = float(counts["total_rows"]) / max(time.monotonic() - began, 1e-3)
        line = spark.createDataFrame(
            [(self.job.name, batch_id, *counts, state, rate)],
            "job_name STRING, batch_id BIGINT, total_rows BIGINT, loaded_rows BIGINT, "
            "unselected_rows BIGINT, error_rows BIGINT, state STRING, rows_per_second DOUBLE",
        )
        now = F.current_timestamp()
        status = self.status.with_session(spark)
        status.append(line.withColumns({"checked_at": now, "checked_on": F.to_date(now)}), token)
        self._tidy(status)

    def _tidy(self, sink: DayTable) -> None:
        if sink.most_segments() >= self.fold_after:
            layout.compact(sink, small_bytes=self.small_bytes)
        version = sink.state()["version"]
        if version and version % self.fold_after == 0:
            sink.vacuum(keep=sink.lists_since(self.keep_seconds))

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        """Start or resume from the checkpoint. Without a trigger: drain what is there and end."""
        writer = messages.writeStream.queryName(self.job.name).option("checkpointLocation", self.checkpoint)
        self.query = writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(self.run_batch).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def alter(self, messages: DataFrame, seconds: float) -> StreamingQuery:
        """Change the batch interval: stop, then resume from the checkpoint."""
        self.stop()
        return self.start(messages, processingTime=f"{seconds} seconds")


def one_stream(*sources: DataFrame) -> DataFrame:
    """Several sources of one table as one stream, so that the table has a single writer."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    return out


def fewer_copies(rows: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """At most two rows of a key from each block of rows that a task handles: the first and the latest.

    The latest is there because the first may be too late to count; so no key and no time is lost.
    """
    names, key = rows.columns, list(key)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def firsts(of: pa.Table) -> np.ndarray:
            nth = of.append_column("_nth", pa.array(np.arange(len(of))))
            return nth.group_by(key, use_threads=False).aggregate([("_nth", "min")]).column("_nth_min").to_numpy()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, times = table.select(key), table.column(names.index(at))
            first = firsts(keys)
            if len(first) < len(table):
                latest_first = pc.array_sort_indices(times.combine_chunks(), order="descending").to_numpy().astype(np.int64)
                latest = latest_first[firsts(keys.take(pa.array(latest_first)))]
                batch = batch.take(pa.array(np.unique(np.concatenate([first, latest]))))
            yield batch

    return rows.mapInArrow(reduce, rows.schema)


def first_arrivals(
    rows: DataFrame, key: Sequence[str], at: str, delay: str = "7 days", spread: Sequence[str] = (), salts: int = 16
) -> DataFrame:
    """Drop repeats within the watermark. Keeps the first copy, where an upsert keeps the last.

    ``spread`` names columns that differ between copies of a key (partition and offset). The copies
    are then first reduced where they are read, block by block, so that a key with very many copies
    does not send them all to one task. This keeps no state, so ``salts``, groups of copies with a
    state of their own, is not used any more. The keys of the watermark's time are kept by RocksDB
    outside the heap.
    """
    keep_state_in_rocksdb(rows.sparkSession)
    marked = (fewer_copies(rows, key, at) if spread else rows).withWatermark(at, delay)
    return marked.dropDuplicatesWithinWatermark(list(key))


def hourly_counts(
    clicks: DataFrame, at: str, by: Sequence[str] = (), delay: str | None = "90 minutes"
) -> DataFrame:
    """Counts per hour of event time.

    With a delay an hour is final once the watermark has passed it, and later rows are not counted.
    Without one every row counts, whenever it comes: write the result in ``complete`` or ``update``
    mode; a count per hour and group is kept for good.
    """
    return (
        (clicks.withWatermark(at, delay) if delay else clicks)
        .groupBy(F.window(at, "1 hour"), *by)
        .agg(F.count(F.lit(1)).alias("visits"))
        .select(F.col("window.start").alias("hour"), *by, "visits")
    )


def kafka_offsets(spark: SparkSession, group: str, progress: dict) -> tuple[DataFrame, DataFrame]:
    """End offsets and read offsets of a batch's Kafka sources, as ``reports.consumer_lag`` takes them."""

    def rows(field: str) -> list[tuple[str, int, int]]:
        found = []
        for source in progress["sources"]:
            value = source.get(field) or {}
            offsets = json.loads(value) if isinstance(value, str) else value
            found += [(t, int(p), int(o)) for t, parts in offsets.items() for p, o in parts.items()]
        return found

    ends = spark.createDataFrame(rows("latestOffset"), "topic STRING, partition INT, end_offset BIGINT")
    read = spark.createDataFrame(rows("endOffset"), "topic STRING, partition INT, committed_offset BIGINT")
    return ends, read.withColumn("group_id", F.lit(group))


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The last hundred batches of a query with their rates; the status table has all of a job."""
    rows = [
        (query.name, p["batchId"], p["timestamp"], p["numInputRows"], float(p.get("processedRowsPerSecond") or 0))
        for p in query.recentProgress
    ]
    return spark.createDataFrame(
        rows, "job_name STRING, batch_id BIGINT, at STRING, input_rows BIGINT, rows_per_second DOUBLE"
    )
