"""A load job into plain Parquet folders, partitioned by batch and day.

A batch writes its own partitions with dynamic partition overwrite, so a batch that runs again after a
failure replaces what it wrote before. Rows, dead letters and errors are counted by ``observe`` in the
write that has to read the batch anyway. A listener appends every progress record of a query.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from sediment.streaming.ingest import LoadJob, check_errors, dead_letters

COUNTERS_SCHEMA = "total_rows BIGINT, loaded_rows BIGINT, unselected_rows BIGINT, error_rows BIGINT, state STRING"
PROGRESS_SCHEMA = (
    "job_name STRING, run_id STRING, batch_id BIGINT, at STRING, input_rows BIGINT, rows_per_second DOUBLE, "
    "state_rows BIGINT, watermark STRING, sources STRING"
)


def write_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that ``rows`` has rows for; all others stay."""
    spread = rows.hint("rebalance", *by)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class PlainLoad:
    """``root/rows`` by batch and day, ``root/letters`` and ``root/counters`` by batch."""

    def __init__(self, job: LoadJob, root: str, day: str = "event_date"):
        self.job, self.root, self.day = job, root, day

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Dead letters first: writing them reads the batch, fills the cache and counts it in one job."""
        spark, seen = batch.sparkSession, Observation()
        good = F.col("_error").isNull()
        chosen = F.coalesce(self.job.where, F.lit(False)) if self.job.where is not None else F.lit(True)
        counts = [
            F.count(F.lit(1)).alias("total_rows"), F.count_if(good & chosen).alias("loaded_rows"),
            F.count_if(good & ~chosen).alias("unselected_rows"), F.count_if(~good).alias("error_rows"),
        ]
        decoded = self.job.decode(batch).persist()
        number = F.lit(batch_id).cast("bigint").alias("batch_id")
        try:
            bad = decoded.observe(seen, *counts).where(~good)
            letters = dead_letters(bad, self.job.name, str(batch_id)).select("*", number)
            write_partitions(letters, f"{self.root}/letters", ["batch_id"])
            found = seen.get
            try:
                check_errors(self.job, found["total_rows"], found["error_rows"])
            except RuntimeError:
                self._count(spark, batch_id, found, "PAUSED")
                raise
            rows = self.job.to_rows(decoded.where(good & chosen).drop("_error")).select("*", number)
            write_partitions(rows, f"{self.root}/rows", ["batch_id", self.day])
            self._count(spark, batch_id, found, "RUNNING")
        finally:
            decoded.unpersist()

    def _count(self, spark: SparkSession, batch_id: int, found: dict, state: str) -> None:
        names = [f.split()[0] for f in COUNTERS_SCHEMA.split(", ")][:-1]
        line = spark.createDataFrame([(*[found[n] for n in names], state)], COUNTERS_SCHEMA)
        line = line.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        write_partitions(line, f"{self.root}/counters", ["batch_id"])

    def start(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start or resume. With no trigger the next batch begins when the last one has ended."""
        writer = messages.writeStream.queryName(self.job.name).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).foreachBatch(self.run_batch).start()

    def alter(self, query: StreamingQuery, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Change the batch bounds or the interval: stop, then resume from the checkpoint."""
        query.stop()
        return self.start(messages, checkpoint, **trigger)


def drain(query: StreamingQuery) -> None:
    """Wait until all there is has been processed, then stop; an error of the query is raised."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def drain_rows(query: StreamingQuery, rows: int, seconds: float = 600) -> None:
    """Wait until a query has read so many rows, then stop it: for one that never runs out of batches."""
    read: dict[int, int] = {}
    ends = time.monotonic() + seconds
    try:
        while sum(read.values()) < rows and time.monotonic() < ends:
            if query.exception() is not None:
                raise query.exception()
            read |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
            time.sleep(0.2)
    finally:
        query.stop()
    if sum(read.values()) < rows:
        raise TimeoutError(f"{sum(read.values())} of {rows} rows after {seconds} seconds")


class ProgressLog(StreamingQueryListener):
    """Appends the progress of each batch of all queries of a session, whatever Spark itself remembers.

    Records are held until there are ``every`` of them or a query ends; ``flush`` writes them at once.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every = spark, path, every
        self.held: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        sources = [{"description": s.description, "start": s.startOffset, "end": s.endOffset} for s in p.sources]
        state = sum(s.numRowsTotal for s in p.stateOperators)
        rate = float(p.processedRowsPerSecond or 0)
        watermark = (p.eventTime or {}).get("watermark")
        self.held.append((p.name, str(p.runId), p.batchId, p.timestamp, p.numInputRows, rate, state, watermark, json.dumps(sources)))
        if len(self.held) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def job_status(progress: DataFrame) -> DataFrame:
    """A row per job from its progress: batches, rows, the last batch, and the most state it held."""
    once = progress.dropDuplicates(["job_name", "run_id", "batch_id", "at"])
    return once.groupBy("job_name").agg(
        F.count_distinct("batch_id").alias("batches"),
        F.sum("input_rows").cast("bigint").alias("input_rows"),
        F.max("batch_id").alias("last_batch"),
        F.max("state_rows").alias("most_state_rows"),
        F.max("at").alias("last_at"),
    )
