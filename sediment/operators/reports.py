"""Reports over tables, files, jobs and topics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions import numbers
from sediment.operators.layout import partition_name
from sediment.sources.day_table import DayTable

# Sizes in bytes per row and days of retention of the planning grid, share of the data
# that is cached, and room left above the cache.
BYTES_PER_ROW = [50, 100, 200]
RETENTION_DAYS = [30, 90]
CACHED_SHARE = 0.25
HEADROOM = 1.15
SLOW_AT, STOP_AT = 300, 1000


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, rows in tables.items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Files and bytes behind each table, from file metadata columns; no data column is read."""
    sizes = []
    for name, rows in tables.items():
        files = rows.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct()
        total = F.coalesce(F.sum("s"), F.lit(0))
        sizes.append(
            files.agg(F.count(F.lit(1)).alias("files"), total.alias("data_bytes")).select(
                F.lit(name).alias("table_name"), "files", "data_bytes", numbers.readable_size(F.col("data_bytes")).alias("size")
            )
        )
    out = sizes[0]
    for one in sizes[1:]:
        out = out.unionByName(one)
    return out


def partition_report(rows: DataFrame, day: str, size: Column) -> DataFrame:
    """Name, rows and size of each partition in name order."""
    grouped = rows.groupBy(day).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(size).cast("bigint").alias("data_bytes")
    )
    return grouped.select(
        partition_name(F.col(day)).alias("partition_name"),
        "row_count",
        "data_bytes",
        numbers.gibibytes(F.col("data_bytes")).alias("data_gb"),
    ).orderBy("partition_name")


def layout_summary(parts: DataFrame, by: Sequence[str], compaction_lag: int = 20) -> DataFrame:
    """Summary of storage units with columns ``n_rows, versions, state``."""
    grouped = parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("n_rows").cast("bigint").alias("row_count"),
        F.round(F.avg("versions"), 1).alias("avg_versions"),
        F.min("versions").alias("min_versions"),
        F.max("versions").alias("max_versions"),
        F.count_if(F.col("state") != "NORMAL").alias("bad_units"),
    )
    return grouped.withColumn("compaction_lagging", F.col("max_versions") > compaction_lag)


def _pressure(files: Column, slow: int, stop: int) -> Column:
    return F.when(files >= stop, "stop").when(files >= slow, "slow").otherwise("ok")


def part_pressure(files: DataFrame, by: Sequence[str], slow: int = SLOW_AT, stop: int = STOP_AT) -> DataFrame:
    """Files per partition with the level at which loading slows down or stops."""
    counted = files.groupBy(*by).agg(F.count_distinct("file").alias("files"))
    return counted.withColumn("level", _pressure(F.col("files"), slow, stop))


def day_table_report(table: DayTable, slow: int = SLOW_AT, stop: int = STOP_AT) -> DataFrame:
    """Rows, bytes, files and file pressure of each stored day."""
    spark, day = table.spark, table.day
    sizes = spark.createDataFrame(table.sizes(), "day STRING, data_bytes BIGINT, files BIGINT")
    rows = table.read().groupBy(F.col(day).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("row_count"))
    return sizes.join(rows, "day", "left").select(
        partition_name(F.col("day").cast("date")).alias("partition_name"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "data_bytes",
        numbers.gibibytes(F.col("data_bytes")).alias("data_gb"),
        "files",
        _pressure(F.col("files"), slow, stop).alias("level"),
    ).orderBy("partition_name")


def capacity_grid(rates: DataFrame) -> DataFrame:
    """Storage for each row size and retention, from a frame with ``rows_per_day``."""
    grid = F.array(
        *[
            F.struct(F.lit(b).alias("bytes_per_row"), F.lit(d).alias("retention_days"))
            for b in BYTES_PER_ROW
            for d in RETENTION_DAYS
        ]
    )
    total = F.col("rows_per_day") * F.col("retention_days") * F.col("bytes_per_row")
    return (
        rates.withColumn("_cell", F.explode(grid))
        .select("*", "_cell.*")
        .drop("_cell")
        .withColumn("total_bytes", total.cast("double"))
        .withColumn("cache_bytes", F.col("total_bytes") * CACHED_SHARE)
        .withColumn("volume_bytes", F.col("cache_bytes") * HEADROOM)
    )


def ingest_rate(rows: DataFrame, at_seconds: Column, tasks: int, interval_seconds: int, bucket: int = 60) -> DataFrame:
    """Rows per second in each minute, and rows per flush at that rate."""
    minute = (at_seconds - F.pmod(at_seconds, F.lit(bucket))).alias("bucket_start")
    counted = rows.groupBy(minute).agg(F.count(F.lit(1)).alias("n_rows"))
    per_second = F.col("n_rows") / F.lit(float(bucket))
    return counted.withColumn("rows_per_second", F.round(per_second, 6)).withColumn(
        "rows_per_flush", F.round(per_second * interval_seconds / tasks, 6)
    )


def storage_audit(listed: DataFrame, registered: DataFrame, name: str = "path") -> DataFrame:
    """Objects in storage against registered parts: ``ok``, ``orphan`` or ``missing``."""
    left = listed.select(name).distinct().withColumn("_listed", F.lit(True))
    right = registered.select(name).distinct().withColumn("_registered", F.lit(True))
    status = (
        F.when(F.col("_listed").isNull(), "missing").when(F.col("_registered").isNull(), "orphan").otherwise("ok")
    )
    return left.join(right, name, "full_outer").select(name, status.alias("status"))


def consumer_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """Messages each group has not read, summed over the partitions of its topics.

    A partition the group never committed counts from offset 0.
    """
    reads = committed.select("group_id", "topic").distinct().join(ends, "topic")
    joined = reads.join(committed, ["group_id", "topic", "partition"], "left")
    behind = F.col("end_offset") - F.coalesce("committed_offset", F.lit(0))
    return joined.groupBy("group_id").agg(
        F.sum(behind).cast("bigint").alias("lag"), F.count(F.lit(1)).alias("partitions")
    )
