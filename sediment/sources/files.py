"""Files in a folder or object store: streams, one-off loads and the ledger of what was loaded."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")
# A stream ignores files older than this against the newest one it has seen (by default seven days),
# without an error. A file that arrives late must be read all the same.
ANY_AGE = "36500d"
LEDGER_SCHEMA = "path STRING, state STRING, loaded_at TIMESTAMP, last_modified TIMESTAMP, error STRING"


def _format_options(
    fmt: str, header: bool, separator: str, quote: str, line_separator: str | None, outer_array: bool
) -> dict[str, str]:
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    options = {}
    if fmt == "csv":
        options = {"header": str(header).lower(), "sep": separator, "quote": quote}
    if fmt == "json" and outer_array:
        options = {"multiLine": "true"}
    if line_separator is not None:
        options["lineSep"] = line_separator
    return options


def file_stream(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: str,
    max_files: int | None = 100,
    glob: str | None = None,
    recursive: bool = True,
    header: bool = False,
    separator: str = ",",
    quote: str = '"',
    line_separator: str | None = None,
    outer_array: bool = False,
) -> DataFrame:
    """Stream of new files, oldest first. ``_file``, ``_modified`` and, for Parquet, ``_row`` tell where a row came from."""
    reader = (
        spark.readStream.format(fmt)
        .schema(schema)
        .options(**_format_options(fmt, header, separator, quote, line_separator, outer_array))
        .option("latestFirst", "false")
        .option("maxFileAge", ANY_AGE)
        .option("recursiveFileLookup", str(recursive).lower())
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    row = [F.col("_metadata.row_index").alias("_row")] if fmt == "parquet" else []
    return reader.load(path).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_modification_time").alias("_modified"),
        *row,
    )


def as_messages(rows: DataFrame, topic: str = "files", sequence: str | None = None) -> DataFrame:
    """Rows of a file stream in the columns of a message stream, so that one job can take both.

    The offset says which of two rows of a file came later: the row's number in a Parquet file, else the
    column ``sequence``, which has to rise within a file. Rows of one file and moment would tie without.
    """
    at = sequence or "_row"
    if at not in rows.columns:
        raise ValueError("name a column that rises within a file as sequence: only Parquet files have row numbers")
    body = F.to_json(F.struct(*[c for c in rows.columns if c not in ("_file", "_modified", "_row")]))
    return rows.select(
        F.col("_file").alias("key"),
        body.alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(-1).alias("partition"),
        F.col(at).cast("bigint").alias("offset"),
        F.col("_modified").alias("timestamp"),
    )


def read_files(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str,
    schema: str | None = None,
    header: bool = False,
    separator: str = ",",
    quote: str = '"',
    line_separator: str | None = None,
    outer_array: bool = False,
) -> DataFrame:
    options = _format_options(fmt, header, separator, quote, line_separator, outer_array)
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(list(paths))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a path: ``path, size, last_modified``. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )


def files_to_load(
    listing: DataFrame,
    ledger: DataFrame,
    as_of: Column | None = None,
    forget_after_days: int | None = None,
    retry_errors: bool = True,
) -> DataFrame:
    """Files the ledger does not hold as loaded.

    By default a file is loaded once for good. With ``forget_after_days`` a ledger entry stops
    counting after that time and the file is loaded again. Without ``retry_errors`` a file whose
    last load failed waits until somebody asks for it.
    """
    loaded = ledger.where("state = 'LOADED'")
    if not retry_errors:
        failed = current_file_states(ledger).where("state = 'ERROR'")
        listing = listing.join(failed.select("path"), "path", "left_anti")
    if forget_after_days is not None:
        loaded = loaded.where(F.col("loaded_at") >= as_of - F.expr(f"INTERVAL {forget_after_days} DAYS"))
    return listing.join(loaded.select("path"), "path", "left_anti")


def current_file_states(ledger: DataFrame) -> DataFrame:
    """Last ledger entry of each file."""
    last = F.max_by(F.struct("state", "last_modified", "error"), F.struct("loaded_at", F.col("state") != "LOADING", "state"))
    return ledger.groupBy("path").agg(
        last.alias("_last"), F.max("loaded_at").alias("loaded_at")
    ).select("path", "_last.*", "loaded_at")


def failed_files(states: DataFrame, state: str = "ERROR", most: int = 50) -> DataFrame:
    """Files in a state, newest first; the report shows the first 50."""
    order = [F.col("last_modified").desc(), F.col("path")]
    return states.where(F.col("state") == state).orderBy(*order).limit(most)


def load_new_files(
    spark: SparkSession,
    path: str,
    ledger_path: str,
    load: Callable[[Sequence[str]], None],
    as_of: Column | None = None,
    per_commit: int = 1_000,
    glob: str | None = None,
    forget_after_days: int | None = None,
    only: Sequence[str] | None = None,
) -> int:
    """Load files that are not in the ledger, ``per_commit`` to a job in path order; returns how many.

    ``load`` gets the paths and must be safe to repeat (an upsert is), because a job that dies between
    loading and the ledger entry loads the same files again. All files are entered as LOADING at the
    start. If a group fails, it is halved until its bad files are found; these end as ERROR, with the
    whole error text. Those are left alone until ``only`` names them.
    """
    now = as_of if as_of is not None else F.current_timestamp()
    listing = list_files(spark, path, glob)
    if only is not None:
        pending = listing.where(F.col("path").isin(list(only)))
    else:
        ledger = read_ledger(spark, ledger_path)
        pending = files_to_load(listing, ledger, now, forget_after_days, retry_errors=False)
    pending = pending.select("path", "last_modified").persist()
    try:
        _enter(pending.withColumn("error", F.lit(None).cast("string")), "LOADING", now, ledger_path)
        done, group = 0, []
        for row in pending.orderBy("path").toLocalIterator():
            group.append((row["path"], row["last_modified"]))
            if len(group) == per_commit:
                done += _load_group(spark, group, load, now, ledger_path)
                group = []
        return done + (_load_group(spark, group, load, now, ledger_path) if group else 0)
    finally:
        pending.unpersist()


def _load_group(spark: SparkSession, group: list[tuple], load: Callable, now: Column, ledger_path: str) -> int:
    failed: dict[str, str] = {}

    def halves(paths: list[str]) -> None:
        """A group that fails is cut in two until the bad files are found: a few jobs for each of them."""
        try:
            load(paths)
        except Exception as problem:
            if len(paths) == 1:
                failed[paths[0]] = str(problem)
            else:
                halves(paths[: len(paths) // 2])
                halves(paths[len(paths) // 2 :])

    halves([path for path, _ in group])
    entries = [(path, modified, failed.get(path)) for path, modified in group]
    rows = spark.createDataFrame(entries, "path STRING, last_modified TIMESTAMP, error STRING")
    for state, chosen in (("LOADED", rows.where("error IS NULL")), ("ERROR", rows.where("error IS NOT NULL"))):
        _enter(chosen, state, now, ledger_path)
    return len(group) - len(failed)


def _enter(rows: DataFrame, state: str, now: Column, ledger_path: str) -> None:
    stamped = rows.withColumns({"state": F.lit(state), "loaded_at": now.cast("timestamp")})
    columns = [c.split()[0] for c in LEDGER_SCHEMA.split(", ")]
    stamped.select(*columns).hint("rebalance").write.mode("append").parquet(ledger_path)


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
