"""The pipeline's inputs, derived from the given tables.

``events`` has unique ids, so replays, staging lists, ledgers and file lists are derived from it by
rule. Each has the same definition in ``oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import numbers, times

AS_OF = "2024-01-20"
TOPIC = "events"
TOPIC_PARTITIONS = 6


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def canonical_events(spark: SparkSession, folder: str) -> DataFrame:
    ms = times.epoch_millis(F.col("ts"))
    return (
        table(spark, folder, "events")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("event_ts", ms)
        .withColumn("event_date", times.day_from_millis(F.col("event_ts")))
        .withColumn(
            "eviction_date",
            times.plus_days(F.col("event_date"), (F.lit(5) + F.col("event_id") % 20).cast("int")),
        )
        .withColumn("_ver", F.col("event_ts"))
        .withColumn("_seq", F.col("event_id"))
        .withColumn("cents", numbers.hundredths(F.col("value")))
    )


def replays(events: DataFrame, moved: bool = False) -> DataFrame:
    """Second deliveries: one event in seven, with a changed value; ``moved`` shifts the day."""
    again = (
        events.where("event_id % 7 = 0")
        .withColumn("cents", F.col("cents") + 100)
        .withColumn("_seq", F.col("_seq") + 1_000_000_000)
    )
    return again.withColumn("event_date", times.plus_days(F.col("event_date"), 1)) if moved else again


def events_with_replays(events: DataFrame) -> DataFrame:
    return events.unionByName(replays(events))


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("uid"),
        F.col("event_type").alias("site"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("vtime"),
    )


def incidents(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").select(F.col("event_id").alias("incident_id"), "ts")


def readings(events: DataFrame) -> DataFrame:
    """Readings whose metric is text, with a trace mark (``T``) instead of a number at times."""
    metric = F.when(F.col("event_id") % 17 == 0, "T").otherwise(F.floor("value").cast("int").cast("string"))
    return events.where("event_type = 'view'").select("ts", metric.alias("metric"))


def staging(events: DataFrame) -> DataFrame:
    """Compliance requests of the night before ``AS_OF``, some users twice."""
    users = events.select("user_id").distinct()
    today, kind = F.lit(AS_OF).cast("date"), F.col("user_id") % 25

    def requests(number: int, operation: str, new_date) -> DataFrame:
        return users.where(kind == number).select(
            today.alias("batch_date"),
            F.lit(operation).alias("operation"),
            "user_id",
            new_date.cast("date").alias("new_eviction_date"),
        )

    later = times.plus_days(today, (F.col("user_id") % 10).cast("int"))
    return (
        requests(0, "DELETE", F.lit(None))
        .unionByName(requests(0, "DELETE", F.lit(None)).where("user_id % 50 = 0"))
        .unionByName(requests(1, "UPDATE", later))
        .unionByName(requests(1, "UPDATE", times.plus_days(later, 3)).where("user_id % 50 = 1"))
        .unionByName(requests(2, "UPDATE", F.lit(None)))
    )


def messages(events: DataFrame) -> DataFrame:
    """The events as JSON messages of a six-partition topic."""
    from sediment.sources.messages import publish_rows

    return publish_rows(
        events.withColumn("eviction_date", F.col("eviction_date").cast("string")),
        TOPIC,
        F.col("event_id"),
        F.col("event_id") % TOPIC_PARTITIONS,
        ["event_id", "user_id", "event_ts", "eviction_date", "event_type", "cents"],
        timestamp=F.col("ts"),
        key=F.col("event_id"),
    )
