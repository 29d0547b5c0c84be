"""Plain Parquet tables in daily folders: lookups by user, rewrites of single days, and their metadata.

A table is ``path/<day>=…/…parquet``, sorted by user within a file and with Bloom filters on the user, so a
scan for some users skips row groups and pages. Deletes and compaction rewrite only the days concerned, by
dynamic partition overwrite. Reports read what Spark knows of the files, not their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import numbers
from sediment.operators.layout import partition_name
from sediment.operators.reports import SLOW_AT, STOP_AT
from sediment.session import scratch_path

#: Ids that go into a scan as a filter; beyond it they are joined.
PUSHED_IDS = 1_000


def write_days(rows: DataFrame, path: str, day: str, user: str, mode: str = "append", distinct_users: int = 100_000) -> None:
    """Write rows into daily folders, sorted by user, with a Bloom filter on the user.

    ``overwrite`` replaces the days that ``rows`` has rows for; ``append`` adds files. ``distinct_users``
    sizes the filter of a row group.
    """
    sorted_rows = rows.hint("rebalance", day).sortWithinPartitions(day, user)
    writer = sorted_rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(day)
    writer = writer.option(f"parquet.bloom.filter.enabled#{user}", "true")
    writer = writer.option(f"parquet.bloom.filter.expected.ndv#{user}", str(distinct_users))
    # Small pages: the page index skips all pages of a sorted file that cannot hold a user.
    writer.option("parquet.page.row.count.limit", "1000").parquet(path)


def few_ids(ids: DataFrame, user: str, most: int = PUSHED_IDS) -> list | None:
    """The different ids as a list, or None if there are more than ``most``."""
    found = ids.select(user).where(F.col(user).isNotNull()).distinct().limit(most + 1).collect()
    return [r[0] for r in found] if len(found) <= most else None


def rows_of_users(table: DataFrame, ids: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows of the users: ids up to ``PUSHED_IDS`` go into the scan, which skips by filter, statistics and page.

    More ids are joined; with a filter on them Spark may still prune by a Bloom filter at run time.
    """
    few = few_ids(ids, user)
    if few is None:
        return table.join(ids.select(user).distinct(), user, "left_semi")
    return table.where(F.col(user).isin(few)) if few else table.where("false")


def rows_scanned(frame: DataFrame) -> int:
    """Rows that the file scans of a frame have read; the frame must have been collected."""
    total, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def days_of(rows: DataFrame, day: str) -> list[str]:
    return sorted(r[0] for r in rows.select(F.col(day).cast("string")).distinct().collect())


def rewrite_days(spark: SparkSession, path: str, days: Sequence[str], day: str, user: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the named days by what ``change`` makes of their rows; all other days stay as they are.

    The new rows are written to the shared folder first, because a folder cannot be read and replaced at
    once; a job that dies before the replacement has changed nothing, and one that dies in it is run
    again with the same result. A day that loses all its rows is removed.
    """
    if not days:
        return
    old = spark.read.parquet(path).where(F.col(day).cast("string").isin(list(days)))
    staged = scratch_path(spark, "rewritten")
    change(old).write.parquet(staged)
    fresh = spark.read.schema(old.schema).parquet(staged)
    left = days_of(fresh, day)
    write_days(fresh, path, day, user, "overwrite")
    files = spark._jvm.org.apache.hadoop.fs
    for gone in sorted(set(days) - set(left)):
        target = files.Path(f"{path}/{day}={gone}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_users(spark: SparkSession, path: str, ids: DataFrame, day: str = "event_date", user: str = "user_id") -> list[str]:
    """Delete users. One scan with the ids in it finds the days; these are rewritten, all users at once."""
    days = days_of(rows_of_users(spark.read.parquet(path), ids, user), day)
    few = few_ids(ids, user)

    def survivors(rows: DataFrame) -> DataFrame:
        if few is None:
            return rows.join(ids.select(user).distinct(), user, "left_anti")
        return rows.where(F.col(user).isNull() | ~F.col(user).isin(few)) if few else rows

    rewrite_days(spark, path, days, day, user, survivors)
    return days


def compact_days(spark: SparkSession, path: str, day: str = "event_date", user: str = "user_id", most_files: int = 1) -> list[str]:
    """Merge the files of days that have more than ``most_files``; returns the days."""
    many = file_list(spark, path, [day]).groupBy(F.col(day).cast("string").alias("d")).agg(F.count(F.lit(1)).alias("files"))
    days = sorted(r["d"] for r in many.where(F.col("files") > most_files).collect())
    rewrite_days(spark, path, days, day, user, lambda rows: rows)
    return days


def file_list(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """``file, bytes, n_rows`` and the partition columns ``by`` of every file of a table.

    All of it comes from metadata; the rows are counted without reading a column.
    """
    grouped = spark.read.parquet(path).groupBy(*by, F.col("_metadata.file_path").alias("file"))
    return grouped.agg(F.first("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def folder_report(spark: SparkSession, path: str, day: str, slow: int = SLOW_AT, stop: int = STOP_AT) -> DataFrame:
    """Rows, files, bytes and file pressure of each day of a table."""
    files = F.count(F.lit(1)).alias("files")
    per_day = file_list(spark, path, [day]).groupBy(day).agg(F.sum("n_rows").cast("bigint").alias("row_count"), files, F.sum("bytes").alias("data_bytes"))
    level = F.when(F.col("files") >= stop, "stop").when(F.col("files") >= slow, "slow").otherwise("ok")
    return per_day.select(
        partition_name(F.col(day)).alias("partition_name"), "row_count", "files", "data_bytes",
        numbers.readable_size(F.col("data_bytes")).alias("size"), level.alias("level"),
    )


def register_files(spark: SparkSession, path: str, manifest: str) -> None:
    """Write the list of the files that a table has now."""
    file_list(spark, path).select("file", "bytes").write.mode("overwrite").parquet(manifest)


def audit_files(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """Files in storage against a manifest: ``ok``, ``resized``, ``orphan`` (not registered) or ``missing``."""
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    listed = stored.load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.col("length").alias("now"))
    known = spark.read.parquet(manifest).select(F.regexp_replace("file", "^file:/+", "/").alias("file"), "bytes")
    status = (
        F.when(F.col("now").isNull(), "missing").when(F.col("bytes").isNull(), "orphan")
        .when(F.col("now") != F.col("bytes"), "resized").otherwise("ok")
    )
    return known.join(listed, "file", "full_outer").select("file", status.alias("status"))


def expired_days(spark: SparkSession, path: str, as_of: str, day: str = "event_date", expires: str = "eviction_date", inclusive: bool = True) -> DataFrame:
    """Days whose every row has expired, from the footers of their files: no row is read.

    The maximum and the counts are pushed into the scan, which takes them from the row groups' statistics.
    A day with a row without a date never expires.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table, rows = session.read.parquet(path), F.count(F.lit(1)).alias("partition_rows")
    # Row groups of nulls alone have no maximum, so the days with a null are left out first, by counts.
    counted = table.groupBy(day).agg(F.count(expires).alias("dated"), rows).where("dated = partition_rows")
    found = table.where(F.col(day).isin([r[0] for r in counted.select(day).collect()]))
    found = found.groupBy(day).agg(F.max(expires).alias("last_eviction"), rows)
    today = F.lit(as_of).cast("date")
    return found.where(F.col("last_eviction") <= today if inclusive else F.col("last_eviction") < today)


def drop_days(spark: SparkSession, path: str, days: DataFrame, day: str = "event_date") -> list[str]:
    """Remove the folders of the named days; returns them."""
    gone, files = days_of(days, day), spark._jvm.org.apache.hadoop.fs
    for one in gone:
        target = files.Path(f"{path}/{day}={one}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return gone


def delete_plan(spark: SparkSession, path: str, ids: DataFrame, day: str = "event_date", user: str = "user_id") -> DataFrame:
    """What deleting each user rewrites, alone and shared: ``user, units, bytes, shared_units, shared_users``.

    A unit is a file. ``bytes`` is the size of a user's files, ``shared_units`` those that another of the
    users is in, and ``shared_users`` how many others share one. Users are bits of a bitmap per file, so
    nobody is paired with a user they share no file with.
    """
    files = spark.read.parquet(path).select(user, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    units = rows_of_users(files, ids, user).withColumnRenamed(user, "user").distinct()
    marked = units.join(_numbered(units.select("user").distinct(), "user"), "user")
    # A bitmap covers 32,768 users; a file has one for each such bucket that it holds users of.
    per_file = marked.groupBy("file", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users")
    )
    others = per_file.groupBy("file").agg(F.sum(F.bitmap_count("users")).alias("in_file"))
    own = marked.join(others, "file")
    totals = own.groupBy("user").agg(
        F.count(F.lit(1)).alias("units"), F.sum("bytes").alias("bytes"), F.count_if(F.col("in_file") > 1).alias("shared_units")
    )
    near = marked.select("user", "file").join(per_file, "file").groupBy("user", "bucket").agg(F.bitmap_or_agg("users").alias("near"))
    met = near.groupBy("user").agg((F.sum(F.bitmap_count("near")) - 1).alias("shared_users"))
    return totals.join(met, "user")


def _numbered(users: DataFrame, user: str) -> DataFrame:
    """Each user with a number from 0 without gaps, by sorted ranges and the counts before them."""
    spark, path = users.sparkSession, scratch_path(users.sparkSession, "numbered")
    ranges = users.repartitionByRange(user).sortWithinPartitions(user).withColumn("_range", F.spark_partition_id())
    ranges.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = {r["_range"]: r["n"] for r in stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, so_far = [], 0
    for number in sorted(sizes):
        before += [F.lit(number), F.lit(so_far).cast("bigint")]
        so_far += sizes[number]
    offset: Column = F.create_map(*before)[F.col("_range")] if before else F.lit(0).cast("bigint")
    return stored.select(user, (offset + F.col("_at")).alias("number"))
