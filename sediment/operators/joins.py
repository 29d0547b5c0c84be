"""Joins: lookups with a size check, hourly joins, and joins on tables bucketed alike."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions import numbers, times
from sediment.session import scratch_path

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of a bucket, as measured before compression.
BUCKET_BYTES = 256 * 1024 * 1024


def measured(side: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a side, by one distributed aggregate.

    Only columns of varying size are read for it; the others count as 8 bytes each.
    """
    size, fixed = F.lit(0), 0
    for field in side.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            fixed += 8
    found = side.agg(F.count(F.lit(1)).alias("n"), F.sum(size + fixed).alias("bytes")).first()
    return found["n"], found["bytes"] or 0


def is_small(side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Rows and bytes of a side against the limits."""
    n, size = measured(side)
    return n <= max_rows and size <= max_bytes


def bucket_count(rows: DataFrame, bytes_per_bucket: int = BUCKET_BYTES, most: int = 100_000) -> int:
    """Buckets for rows of this size, so that a bucket is one task's work at any size."""
    return min(most, max(1, -(-measured(rows)[1] // bytes_per_bucket)))


def stored_buckets(spark: SparkSession, table: str) -> int:
    """The bucket count that a catalog table was written with."""
    described = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Num Buckets'").first()
    return int(described["data_type"])


def broadcast_if_small(side: DataFrame, **limits: int) -> DataFrame:
    """Mark a side for broadcast if its measured size allows it, else leave the choice to Spark."""
    return F.broadcast(side) if is_small(side, **limits) else side


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: Sequence[str],
    how: str,
    spread: str | None = None,
    salts: int = 16,
    **limits: int,
) -> DataFrame:
    """Join rows to a side that has one row per key (``inner``, ``left``, semi or anti).

    A small side is broadcast. A larger one is shuffled; with ``spread``, a column that differs
    between rows of one key, the rows of a hot key are dealt over ``salts`` tasks and its lookup row
    is copied to each, so a key holding much of the table is not one task's work. Rows without a key
    match nothing and are dealt out too; all other lookup rows are sent once.
    """
    if is_small(lookup, **limits):
        return rows.join(F.broadcast(lookup), list(key), how)
    if spread is None:
        return rows.join(lookup, list(key), how)
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    keyless = functools.reduce(Column.__or__, [F.col(k).isNull() for k in key])
    hot = hot_keys(rows, key, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if hot is None:
        dealt = rows.withColumn("_salt", F.when(keyless, salt).otherwise(0))
        copies = lookup.withColumn("_salt", F.lit(0))
        return dealt.join(copies, [*key, "_salt"], how).drop("_salt")
    few = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    dealt = rows.join(few, list(key), "left").withColumn("_salt", F.when(keyless | F.col("_hot"), salt).otherwise(0))
    dealt = dealt.drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = lookup.join(few, list(key), "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(copies, [*key, "_salt"], how).drop("_salt")


def hourly_summary(
    readings: DataFrame,
    at: str,
    averages: Mapping[str, str],
    text_max: Mapping[str, str],
    keep: Column | None = None,
) -> DataFrame:
    """Readings per hour: count, averages of text columns used as numbers, and largest text."""
    chosen = readings if keep is None else readings.where(keep)
    return chosen.groupBy(times.hour_of(F.col(at)).alias("hour")).agg(
        F.count(F.lit(1)).alias("readings"),
        *[F.avg(numbers.lenient_double(F.col(c))).alias(n) for n, c in averages.items()],
        *[F.max(c).alias(n) for n, c in text_max.items()],
    )


def incidents_in_band(
    incidents: DataFrame,
    readings: DataFrame,
    incident_id: str,
    incident_at: str,
    reading_at: str,
    band: str,
    low: float,
    high: float,
    averages: Mapping[str, tuple[str, int]],
    text_max: Mapping[str, str],
    top: int = 20,
) -> DataFrame:
    """Hours with most incidents among those whose readings lie in a band.

    The query joins every incident to every reading of its hour and groups by the same hour. Within
    one group each reading occurs once per incident, so the average over pairs equals the average
    over readings, and the distinct count and the maximum do not see the repetition. Each side is
    therefore reduced to one row per hour first; the pairs are never built. The filter on the
    reading side makes the left join an inner one.
    """
    inside = numbers.lenient_double(F.col(band)).between(low, high)
    weather = hourly_summary(
        readings, reading_at, {n: c for n, (c, _) in averages.items()}, text_max, inside
    )
    counted = incidents.groupBy(times.hour_of(F.col(incident_at)).alias("hour")).agg(
        F.count_distinct(incident_id).alias("incidents")
    )
    rounded = [
        numbers.cut_decimals(F.col(name), places).alias(name) for name, (_, places) in averages.items()
    ]
    return (
        counted.join(weather, "hour")
        .select("incidents", *rounded, *text_max, times.hour_label(F.col("hour")).alias("hour"))
        .orderBy(F.col("incidents").desc(), "hour")
        .limit(top)
    )


def with_hourly_readings(
    incidents: DataFrame,
    readings: DataFrame,
    incident_at: str,
    reading_at: str,
    averages: Mapping[str, str],
    text_max: Mapping[str, str],
) -> DataFrame:
    """Every incident with the summary of its hour; incidents without readings stay."""
    weather = hourly_summary(readings, reading_at, averages, text_max)
    joined = incidents.withColumn("hour", times.hour_of(F.col(incident_at))).join(weather, "hour", "left")
    return joined.withColumn("readings", F.coalesce("readings", F.lit(0)))


def hot_keys(rows: DataFrame, key: Sequence[str], buckets: int, nulls: bool = False) -> DataFrame | None:
    """Keys with more than a quarter of an even bucket's share of the rows, or None.

    At most ``4 * buckets`` such keys can exist, so the list is small whatever the data. Keys with a
    NULL, which join with nothing, are left out unless ``nulls`` is set. One aggregate gives both the
    counts and their total.
    """
    counts, seen, most = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), Observation(), 4 * buckets
    top = counts.observe(seen, F.sum("_n").alias("total")).orderBy(F.desc("_n")).limit(most).collect()
    hot = [r[:-1] for r in top if r["_n"] * most > seen.get["total"]] if top else []
    if not nulls:
        hot = [r for r in hot if None not in r]
    return rows.sparkSession.createDataFrame(hot, rows.select(*key).schema) if hot else None


def save_bucketed(rows: DataFrame, table: str, path: str, key: Sequence[str], buckets: int) -> None:
    """Write a bucketed catalog table. A bucket too big for one task is written by several."""
    bucket = F.pmod(F.hash(*key), F.lit(buckets))
    (
        rows.withColumn("_bucket", bucket)
        .hint("rebalance", "_bucket")
        .drop("_bucket")
        .write.format("parquet")
        .bucketBy(buckets, *key)
        .sortBy(*key)
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(table)
    )


class BucketedPair:
    """Two tables bucketed by the same key into the same number of buckets.

    Joining them needs no shuffle. A bucket is read by one task, so rows of hot keys are stored
    apart and joined with a broadcast of the few lookup rows they need.
    """

    def __init__(self, spark: SparkSession, buckets: int, key: Sequence[str]):
        self.spark, self.buckets, self.key = spark, buckets, list(key)
        self.prefix = f"sediment_{uuid.uuid4().hex[:12]}"
        self.root = scratch_path(spark, "bucketed")
        self.hot: DataFrame | None = None

    @classmethod
    def sized(
        cls, rows: DataFrame, lookup: DataFrame, key: Sequence[str], bytes_per_bucket: int = BUCKET_BYTES
    ) -> BucketedPair:
        """Write both tables with as many buckets as the rows' bytes need; the count is part of the tables."""
        buckets = bucket_count(rows, bytes_per_bucket)
        return cls(rows.sparkSession, buckets, key).write(rows, lookup)

    def _save(self, rows: DataFrame, name: str) -> None:
        save_bucketed(rows, f"{self.prefix}_{name}", f"{self.root}/{name}", self.key, self.buckets)

    def _lookup(self) -> DataFrame:
        return self.spark.table(f"{self.prefix}_lookup")

    def _join_hot(self, rows: DataFrame, hot: DataFrame) -> DataFrame:
        needed = self._lookup().join(F.broadcast(hot), self.key, "left_semi")
        return rows.join(broadcast_if_small(needed), self.key)

    def write_lookup(self, lookup: DataFrame) -> BucketedPair:
        """``lookup`` has one row per key."""
        self._save(lookup, "lookup")
        return self

    def write(self, rows: DataFrame, lookup: DataFrame) -> BucketedPair:
        self.hot = hot_keys(rows, self.key, self.buckets)
        if self.hot is not None:
            few = F.broadcast(self.hot)
            rows.join(few, self.key, "left_semi").write.parquet(f"{self.root}/hot_rows")
            rows = rows.join(few, self.key, "left_anti")
        self._save(rows, "rows")
        return self.write_lookup(lookup)

    def join(self) -> DataFrame:
        rows = self.spark.table(f"{self.prefix}_rows")
        joined = rows.join(self._lookup().hint("merge"), self.key)
        if self.hot is not None:
            hot_rows = self.spark.read.parquet(f"{self.root}/hot_rows")
            joined = joined.unionByName(self._join_hot(hot_rows, self.hot))
        return joined

    def join_shuffled(self, rows: DataFrame) -> DataFrame:
        """Join rows that are not bucketed: only they are shuffled, into the lookup's buckets."""
        buckets = stored_buckets(self.spark, f"{self.prefix}_lookup")
        hot = hot_keys(rows, self.key, buckets)
        cold = rows if hot is None else rows.join(F.broadcast(hot), self.key, "left_anti")
        joined = cold.repartition(buckets, *self.key).join(self._lookup().hint("merge"), self.key)
        if hot is not None:
            hot_rows = rows.join(F.broadcast(hot), self.key, "left_semi")
            joined = joined.unionByName(self._join_hot(hot_rows, hot))
        return joined

    def drop(self) -> None:
        for name in ("rows", "lookup"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
