"""Physical layout: buckets, the partition calendar, compaction, schema changes, NOT NULL."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions import times
from sediment.operators.joins import save_bucketed
from sediment.sources.day_table import DayTable

# Three buckets per compute node of a seven-node cluster; days kept and pre-created.
BUCKETS = 21
KEEP_DAYS = 90
AHEAD_DAYS = 3


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_skew(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows in total, buckets in use, rows of the fullest bucket against the average."""
    per_bucket = rows.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return per_bucket.agg(
        F.sum("n").alias("total_rows"),
        F.count(F.lit(1)).alias("used_buckets"),
        F.max("n").alias("largest"),
        F.round(F.max("n") / F.avg("n"), 6).alias("max_over_avg"),
    )


def rows_per_partition(rows: DataFrame, day: Column) -> DataFrame:
    return rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("partition_rows"))


def partition_name(day: Column) -> Column:
    """``p20240103``."""
    return F.concat(F.lit("p"), F.date_format(day, "yyyyMMdd"))


def partition_calendar(
    rows: DataFrame, day: str, as_of: str, back: int = KEEP_DAYS, ahead: int = AHEAD_DAYS
) -> DataFrame:
    """Every day a partition should exist for, and whether the table has it."""
    today = F.lit(as_of).cast("date")
    span = F.sequence(F.date_sub(today, back), F.date_add(today, ahead))
    calendar = rows.sparkSession.range(1).select(F.explode(span).alias(day))
    present = rows.select(day).distinct().withColumn("_here", F.lit(True))
    return calendar.join(present, day, "left").select(
        day,
        partition_name(F.col(day)).alias("partition_name"),
        F.coalesce("_here", F.lit(False)).alias("has_rows"),
        (F.col(day) >= today).alias("upcoming"),
    )


def outside_window(day: Column, as_of: str | Column, back: int = KEEP_DAYS, ahead: int = AHEAD_DAYS) -> Column:
    today = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("date")
    return ~day.between(F.date_sub(today, back), F.date_add(today, ahead))


def compact(table: DayTable, days: Sequence[str] | None = None, small_bytes: int | None = None) -> list[str]:
    """Rewrite days into well-sized files; returns the days changed.

    With ``small_bytes`` only folders whose files are smaller than that on average are merged, where
    a day has several such files (small compaction: rows that sit in large files are not rewritten).
    Without it the named days are rewritten whole (full compaction).
    """
    table.fold()
    chosen: dict[str, list[str]] = {}
    files_of: dict[str, int] = {}
    for day, commit, size, files in table.segments(days):
        if small_bytes is None or size < small_bytes * files:
            chosen.setdefault(day, []).append(commit)
            files_of[day] = files_of.get(day, 0) + files
    if small_bytes is not None:
        chosen = {day: commits for day, commits in chosen.items() if files_of[day] > 1}
    if chosen:
        table.merge_segments(chosen)
    return sorted(chosen)


def rebucket(
    spark: SparkSession, source: str, target: str, path: str, key: Sequence[str], buckets: int
) -> DataFrame:
    """Copy a bucketed table to another bucket count; raises if the row count changed."""
    save_bucketed(spark.table(source), target, path, key, buckets)
    copied = spark.table(target)
    before, after = spark.table(source).count(), copied.count()
    if before != after:
        raise RuntimeError(f"{source} has {before} rows, {target} has {after}")
    return copied


def evolve(
    rows: DataFrame,
    add: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
    retype: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add (as NULL), drop, rename and retype columns. ``_failed`` counts values lost by a retype."""
    out = rows.drop(*drop).withColumnsRenamed(dict(rename or {}))
    lost = [F.lit(0)]
    changes = {}
    for name, kind in (retype or {}).items():
        value = F.col(name).try_cast(kind)
        lost.append((F.col(name).isNotNull() & value.isNull()).cast("int"))
        changes[name] = value
    total = lost[0]
    for one in lost[1:]:
        total = total + one
    out = out.withColumn("_failed", total)
    out = out.withColumns(changes) if changes else out
    return out.withColumns({n: F.lit(None).cast(k) for n, k in (add or {}).items()}) if add else out


def union_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows written before and after a column was added."""
    return old.unionByName(new, allowMissingColumns=True)


def not_null_violations(rows: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with the names of the missing columns."""
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    marked = rows.withColumn("missing", missing)
    return marked.where(F.length("missing") == 0).drop("missing"), marked.where(F.length("missing") > 0)


def ensure_table(spark: SparkSession, name: str, schema: str, path: str, by: Sequence[str] = ()) -> None:
    partitioned = f"PARTITIONED BY ({', '.join(by)})" if by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {partitioned} LOCATION '{path}'")


def create_table(spark: SparkSession, name: str, columns: Mapping[str, str], by: Sequence[str] = ()) -> None:
    """A catalog table; a column may have a default (``STRING DEFAULT 'new'``), which inserts may leave out."""
    listed = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
    partitioned = f"PARTITIONED BY ({', '.join(by)})" if by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({listed}) USING parquet {partitioned}")


def insert_rows(rows: DataFrame, name: str, replace: bool = False) -> None:
    """Insert by column name; columns that the rows lack take the table's defaults."""
    view = f"_insert_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    named = ", ".join(f"`{c}`" for c in rows.columns)
    verb = "OVERWRITE" if replace else "INTO"
    rows.sparkSession.sql(f"INSERT {verb} {name} ({named}) SELECT {named} FROM {view}")
    rows.sparkSession.catalog.dropTempView(view)


def add_columns(spark: SparkSession, name: str, columns: Mapping[str, str]) -> None:
    """Add columns; rows that are there already read as their defaults."""
    listed = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({listed})")


def empty_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_defaults(rows: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    return rows.withColumns({n: F.coalesce(F.col(n), c) for n, c in defaults.items()})


def as_millis(rows: DataFrame, column: str) -> DataFrame:
    """Accept timestamps where epoch milliseconds are stored."""
    kind = rows.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return rows.withColumn(column, times.epoch_millis(F.col(column)))
    return rows
