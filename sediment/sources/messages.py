"""Topic messages: a Kafka reader, and a stored message log with the same columns for replays.

Message columns: ``key, value, topic, partition, offset, timestamp``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.sources import feeds
from sediment.sources.files import ANY_AGE

MESSAGE_SCHEMA = (
    "key STRING, value STRING, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
)
Start = str | Mapping[int, int]


def kafka_options(
    brokers: str,
    topic: str,
    start: Start = "end",
    max_rows: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Reader options. ``start``: ``beginning``, ``end`` or ``{partition: offset}``."""
    if isinstance(start, str):
        offsets = {"beginning": "earliest", "end": "latest"}[start]
    else:
        offsets = json.dumps({topic: {str(p): o for p, o in sorted(start.items())}})
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": offsets,
        "failOnDataLoss": "true",
    }
    if max_rows:
        options["maxOffsetsPerTrigger"] = str(max_rows)
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    return options


def trigger_options(max_seconds: float | None) -> dict:
    """Arguments for ``DataStreamWriter.trigger``: a fixed interval, or drain what is there."""
    if max_seconds is None:
        return {"availableNow": True}
    return {"processingTime": f"{max_seconds} seconds"}


def kafka_messages(spark: SparkSession, **kwargs) -> DataFrame:
    """Stream of a topic. Needs Spark's Kafka package on the cluster."""
    reader = spark.readStream.format("kafka").options(**kafka_options(**kwargs))
    return reader.load().select(
        F.col("key").cast("string"),
        F.col("value").cast("string"),
        "topic",
        "partition",
        "offset",
        "timestamp",
    )


def replay_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of a stored message log."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA).option("latestFirst", "false")
    reader = reader.option("maxFileAge", ANY_AGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path)


def stored_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).parquet(path)


def from_offsets(messages: DataFrame, start: Mapping[int, int]) -> DataFrame:
    """Messages at or after the start offset of their partition; unlisted partitions are not read."""
    pairs = [F.lit(x) for p in sorted(start) for x in (int(p), int(start[p]))]
    first = F.create_map(*pairs)[F.col("partition")]
    return messages.where(F.col("offset") >= first)


def publish_rows(
    rows: DataFrame,
    topic: str,
    position: Column,
    partition: Column,
    columns: Sequence[str] | None = None,
    timestamp: Column | None = None,
    key: Column | None = None,
    as_csv: bool = False,
) -> DataFrame:
    """Rows as messages. ``position`` is a rising number unique in its partition; gaps are allowed."""
    fields = F.struct(*(columns or rows.columns))
    body = F.to_csv(fields) if as_csv else F.to_json(fields)
    return rows.select(
        (key if key is not None else F.lit(None)).cast("string").alias("key"),
        body.alias("value"),
        F.lit(topic).alias("topic"),
        partition.cast("int").alias("partition"),
        position.cast("bigint").alias("offset"),
        (timestamp if timestamp is not None else F.current_timestamp()).cast("timestamp").alias("timestamp"),
    )


def live_clicks(spark: SparkSession, per_second: int = 5, seed: str = "clicks") -> DataFrame:
    """Endless stream of generated clicks at a fixed rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", str(per_second)).load()
    return click_messages(ticks, "value", F.unix_seconds("timestamp"), seed)


def click_messages(rows: DataFrame, row_id: str, at_seconds: Column, seed: str = "clicks") -> DataFrame:
    """One click per input row: user, weighted site and a visit time up to 90 minutes back.

    Every draw comes from a hash of the row id, so a rerun gives the same clicks.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))

    def draw(slot: int, size: int) -> Column:
        word = F.conv(F.substring("_digest", 1 + 8 * slot, 8), 16, 10).cast("bigint")
        return F.pmod(word, F.lit(size))

    total = sum(feeds.CLICK_SITES.values())
    bounds, running = [], 0
    for name, weight in feeds.CLICK_SITES.items():
        running += weight
        bounds.append(F.when(F.col("_pick") < running, F.lit(name)))
    site = F.coalesce(*bounds)
    late = draw(2, feeds.CLICK_MAX_JITTER + 1) * draw(3, feeds.CLICK_JITTER_FACTORS)
    return (
        rows.select(F.col(row_id), at_seconds.alias("_at"), digest.alias("_digest"))
        .withColumn("_pick", draw(1, total))
        .select(
            row_id,
            (draw(0, feeds.CLICK_USERS) + 1).alias("uid"),
            site.alias("site"),
            (F.col("_at") - late).alias("vtime"),
            late.alias("late_seconds"),
        )
    )
