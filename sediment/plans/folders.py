"""Queries over plain Parquet folders, message logs with offsets, and streams that load them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import times
from sediment.operators import aggregates, compliance, folders, joins, layout, rollup
from sediment.plans import inputs
from sediment.plans.registry import query
from sediment.plans.tables import by_day, stored_columns
from sediment.session import scratch_path
from sediment.sources import decode, files, message_log
from sediment.streaming import ingest, load, stateful

FIELDS = "event_id BIGINT, user_id BIGINT, event_ts BIGINT, eviction_date DATE, cents BIGINT"
LOOKED_UP = 5


def _day_folders(spark: SparkSession, rows: DataFrame, label: str, parts: int = 1) -> str:
    """Rows in daily folders, written in so many appends."""
    path = scratch_path(spark, label)
    for part in range(parts):
        folders.write_days(rows.where(F.pmod("event_id", F.lit(parts)) == part), path, "event_date", "user_id")
    return path


def _dense_messages(events: DataFrame) -> DataFrame:
    """The messages of the topic with offsets that count from 0 in each partition; one in fifty is broken."""
    sent = inputs.messages(events)
    broken = F.expr("substring(value, 1, length(value) - 1)")
    value = F.when(F.col("offset") % 50 == 0, broken).otherwise(F.col("value"))
    return sent.withColumns({"value": value, "offset": F.floor(F.col("offset") / inputs.TOPIC_PARTITIONS).cast("bigint")})


def _log(spark: SparkSession, folder: str) -> tuple[str, int]:
    """A stored log and the number of offsets of its longest partition."""
    path = scratch_path(spark, "message-log")
    message_log.write_log(_dense_messages(inputs.canonical_events(spark, folder)), path)
    last = inputs.table(spark, folder, "events").agg(F.max("event_id")).first()[0] or 0
    return path, last // inputs.TOPIC_PARTITIONS + 1


def _job(name: str, max_errors: int = 10**9) -> ingest.LoadJob:
    return ingest.LoadJob(
        name,
        lambda batch: decode.decode_json(batch, FIELDS),
        lambda good: good.withColumn("event_date", times.day_from_millis(F.col("event_ts"))),
        F.col("user_id") > 0,
        max_errors=max_errors,
        max_error_ratio=1.0,
    )


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Rows per day of a plain load, and its dead letters per day of their message."""
    rows = by_day(spark.read.parquet(f"{root}/rows")).withColumn("kind", F.lit("stored"))
    letters = spark.read.parquet(f"{root}/letters").groupBy(F.col("captured_on").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("source_offset").alias("total_cents")
    )
    return rows.unionByName(letters.withColumn("kind", F.lit("dead letters")))


@query
def message_stream_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """First and last offset and rows of each partition in each batch, from start offsets by partition."""
    path, offsets = _log(spark, folder)
    share = offsets // 4 + 1
    out = scratch_path(spark, "bounds")
    stream = message_log.stream_log(spark, path, f"{out}/positions.json", {0: 7, 2: 0, 5: 3}, max_rows=3 * share)

    def keep(batch: DataFrame, number: int) -> None:
        found = batch.groupBy("partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count(F.lit(1)).alias("n_rows"))
        load.write_partitions(found.withColumn("batch_id", F.lit(number).cast("bigint")), f"{out}/batches", ["batch_id"])

    load.drain(stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(keep).start())
    kept = spark.read.parquet(f"{out}/batches")
    return kept.select(*[F.col(c).cast("bigint").alias(c) for c in ("batch_id", "partition", "first_offset", "last_offset", "n_rows")])


def _load(spark: SparkSession, folder: str, name: str, batches: int = 3) -> tuple[load.PlainLoad, Callable[[int], DataFrame], str]:
    path, offsets = _log(spark, folder)
    root = scratch_path(spark, name)
    rows = inputs.TOPIC_PARTITIONS * (offsets // batches + 1)

    def stream(share: int = 1) -> DataFrame:
        return message_log.stream_log(spark, path, f"{root}/positions.json", "beginning", max_rows=rows // share)

    return load.PlainLoad(_job(name), root), stream, f"{root}/checkpoint"


@query
def load_to_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Messages in bounded batches into daily folders: rows per day, and dead letters."""
    job, stream, checkpoint = _load(spark, folder, "load_to_folders")
    load.drain(job.start(stream(), checkpoint))
    return _stored(spark, job.root)


@query
def error_gate(spark: SparkSession, folder: str) -> DataFrame:
    """A batch over the limit stops the job before its rows are written; with the limit raised it goes on."""
    job, stream, checkpoint = _load(spark, folder, "error_gate")
    strict = load.PlainLoad(_job("error_gate", max_errors=0), job.root)
    stopped = False
    try:
        load.drain(strict.start(stream(), checkpoint))
    except StreamingQueryException as problem:
        stopped = "TooManyErrors" in str(problem)
        if not stopped:
            raise
    paused = spark.read.parquet(f"{job.root}/counters").where("state = 'PAUSED'").count()
    load.drain(job.start(stream(), checkpoint))
    totals = spark.read.parquet(f"{job.root}/counters").agg(*[F.sum(c).alias(c) for c in ("total_rows", "loaded_rows", "error_rows")])
    return totals.select("*", F.lit(stopped).alias("stopped"), F.lit(paused).cast("bigint").alias("paused_batches"))


@query
def replayed_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches, the first delivered again after the second: nothing is there twice."""
    root = scratch_path(spark, "replayed")
    messages = _dense_messages(inputs.canonical_events(spark, folder))
    job = load.PlainLoad(_job("replayed_batch"), root)
    for number in (0, 1, 0):
        job.run_batch(messages.where(F.col("offset") % 2 == number), number)
    return _stored(spark, root)


@query
def pause_and_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Stopped after the first half of the log, resumed with other batch bounds when the rest is there."""
    events = inputs.canonical_events(spark, folder)
    last = events.agg(F.max("event_id")).first()[0] or 0
    half, path, root = last // inputs.TOPIC_PARTITIONS // 2, scratch_path(spark, "halves"), scratch_path(spark, "paused")
    messages, job = _dense_messages(events), load.PlainLoad(_job("pause_and_resume"), root)

    def stream(most: int) -> DataFrame:
        return message_log.stream_log(spark, path, f"{root}/positions.json", "beginning", max_rows=most)

    message_log.write_log(messages.where(F.col("offset") < half), path)
    running = job.start(stream(inputs.TOPIC_PARTITIONS * (half + 1)), f"{root}/checkpoint")
    running.processAllAvailable()
    message_log.write_log(messages.where(F.col("offset") >= half), path)
    load.drain(job.alter(running, stream(inputs.TOPIC_PARTITIONS * (half // 2 + 1)), f"{root}/checkpoint"))
    return _stored(spark, root)


@query
def job_status(spark: SparkSession, folder: str) -> DataFrame:
    """Batches and rows of a job, and its lag, from every progress record."""
    job, stream, checkpoint = _load(spark, folder, "job_status", batches=5)
    progress = load.ProgressLog(spark, f"{job.root}/progress", every=3)
    spark.streams.addListener(progress)
    try:
        load.drain(job.start(stream(), checkpoint))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(progress)
        progress.flush()
    status = load.job_status(spark.read.parquet(f"{job.root}/progress"))
    errors = spark.read.parquet(f"{job.root}/counters").agg(F.sum("error_rows").alias("error_rows"))
    read = message_log.committed_offsets(spark, f"{job.root}/positions.json", "job_status", inputs.TOPIC)
    return status.select("job_name", "input_rows", (F.col("batches") >= 5).alias("many_batches")).withColumns(
        {"error_rows": F.lit(errors.first()[0]), "partitions": F.lit(read.count()).cast("bigint")}
    )


@query
def stream_newest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Events and both deliveries of changes in mixed batches, with a restart: the newest row of each key."""
    events = inputs.canonical_events(spark, folder)
    moved = inputs.replays(events, moved=True).withColumn("_seq", F.col("_seq") + 1)
    sent = events.unionByName(inputs.replays(events)).unionByName(moved).select("event_id", "event_date", "cents", "_seq")
    root = scratch_path(spark, "newest")
    for half in (0, 1):
        some = sent.where(F.pmod(F.xxhash64("event_id", "_seq"), F.lit(2)) == half)
        some.repartition(2, F.xxhash64("_seq")).write.mode("append").parquet(f"{root}/in")
        reader = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", "1").option("maxFileAge", files.ANY_AGE)
        changes = stateful.newest_rows(reader.parquet(f"{root}/in"), ["event_id"], ["_seq"], keep="7 days")

        def keep(batch: DataFrame, number: int) -> None:
            load.write_partitions(batch.withColumn("batch_id", F.lit(number).cast("bigint")), f"{root}/changes", ["batch_id"])

        writer = changes.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
        load.drain_rows(writer.foreachBatch(keep).trigger(processingTime="1 second").start(), some.count())
    current = stateful.latest_changes(spark.read.parquet(f"{root}/changes"), ["event_id"], F.col("batch_id"))
    return current.select("event_id", F.col("event_date").cast("string").alias("event_date"), "cents")


@query
def two_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A topic and a folder as one stream. A file holds two versions of each even event; the later row wins."""
    events, root = inputs.canonical_events(spark, folder), scratch_path(spark, "two-sources")
    path, _ = _log(spark, folder)
    even = stored_columns(events, "event_ts").where("event_id % 2 = 0").drop("event_date")
    both = even.withColumn("version", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("cents", F.col("cents") + 100 * F.col("version"))
    both.repartition(2, "event_id").sortWithinPartitions("version", "event_id").drop("version").write.parquet(f"{root}/in")
    schema = "event_id BIGINT, user_id BIGINT, eviction_date DATE, cents BIGINT, event_ts BIGINT"
    from_files = files.as_messages(files.file_stream(spark, f"{root}/in", "parquet", schema))
    topic = message_log.stream_log(spark, path, f"{root}/positions.json", "beginning")
    good = decode.decode_json(ingest.one_stream(topic, from_files), FIELDS).where("_error IS NULL")
    good = good.select("event_id", "cents", "topic", "timestamp", "offset", "partition")
    newest = stateful.newest_rows(good, ["event_id"], list(ingest.ARRIVAL))

    def keep(batch: DataFrame, number: int) -> None:
        load.write_partitions(batch.withColumn("batch_id", F.lit(number).cast("bigint")), f"{root}/changes", ["batch_id"])

    load.drain(newest.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep).start())
    current = stateful.latest_changes(spark.read.parquet(f"{root}/changes"), ["event_id"], F.col("batch_id"))
    return current.select("event_id", "cents", "topic")


@query
def file_stream_rows(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files read as a stream, a second folder of them after the first; rows know their file."""
    root = scratch_path(spark, "file-stream")
    rows = inputs.canonical_events(spark, folder).select("event_id", "event_type", "cents")
    out = None
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).repartition(2).write.csv(f"{root}/in/{half}", header=True)
        stream = files.file_stream(spark, f"{root}/in", "csv", "event_id BIGINT, event_type STRING, cents BIGINT", 1, "*.csv", header=True)
        writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
        out = spark.read.schema(stream.schema).parquet(f"{root}/out")
    return out.groupBy("event_type", F.regexp_extract("_file", "in/([01])/", 1).alias("half")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("total_cents")
    )


@query
def load_files_once(spark: SparkSession, folder: str) -> DataFrame:
    """Files loaded once: a second call finds the new files only, and a broken file ends as ERROR."""
    root = scratch_path(spark, "load-once")
    events, schema = stored_columns(inputs.canonical_events(spark, folder)), "event_id BIGINT, cents BIGINT"
    loaded = []

    def take(paths) -> None:
        if any("broken" in p for p in paths):
            raise ValueError("a broken file")
        files.read_files(spark, paths, "json", schema).write.mode("append").parquet(f"{root}/rows")

    for half in (0, 1):
        some = events.where(F.col("event_id") % 2 == half).select("event_id", "cents")
        some.repartition(3).write.json(f"{root}/in/{half}")
        if half:
            spark.range(1).select(F.lit("x")).coalesce(1).write.text(f"{root}/in/broken")
        loaded.append(files.load_new_files(spark, f"{root}/in", f"{root}/ledger", take, glob="part-*"))
    states = files.current_file_states(files.read_ledger(spark, f"{root}/ledger"))
    rows = spark.read.schema(schema).parquet(f"{root}/rows").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("total_cents"))
    return rows.withColumns(
        {
            "failed_files": F.lit(states.where("state = 'ERROR'").count()).cast("bigint"),
            "loaded_twice": F.lit(sum(loaded) != states.where("state = 'LOADED'").count()),
        }
    )


@query
def user_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of five users out of the daily folders; the ids are part of the scan."""
    events = inputs.canonical_events(spark, folder)
    path = _day_folders(spark, stored_columns(events), "lookup")
    ids = events.select("user_id").distinct().orderBy("user_id").limit(LOOKED_UP)
    return folders.rows_of_users(spark.read.parquet(path), ids).select("event_id", "user_id", F.col("event_date").cast("string").alias("event_date"))


@query
def folder_removal_proof(spark: SparkSession, folder: str) -> DataFrame:
    """Staged users deleted from the folders: their rows before, the rows left, and those of all others."""
    events = inputs.canonical_events(spark, folder)
    path = _day_folders(spark, stored_columns(events), "proof", parts=2)
    ids = compliance.staged_ids(inputs.staging(events), inputs.AS_OF)
    before = folders.rows_of_users(events, ids).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows_before"))
    folders.delete_users(spark, path, ids)
    left = folders.rows_of_users(spark.read.parquet(path), ids).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows_left"))
    proof = before.join(left, "user_id", "left").na.fill(0, ["rows_left"])
    others = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_before")).select(F.lit(-1).cast("bigint").alias("user_id"), "rows_before", F.lit(0).cast("bigint").alias("rows_left"))
    return proof.unionByName(others)


@query
def folder_delete_user(spark: SparkSession, folder: str) -> DataFrame:
    """One user deleted from plain daily folders; the files of other days stay."""
    events = inputs.canonical_events(spark, folder)
    path = _day_folders(spark, stored_columns(events), "folder-delete")
    folders.delete_users(spark, path, events.where("user_id = 8").select("user_id").distinct())
    return by_day(spark.read.parquet(path))


@query
def folder_compact(spark: SparkSession, folder: str) -> DataFrame:
    """Three appends merged: rows per day, and one file each."""
    events = stored_columns(inputs.canonical_events(spark, folder))
    path = _day_folders(spark, events, "folder-compact", parts=3)
    folders.compact_days(spark, path)
    spread = folders.file_list(spark, path, ["event_date"]).groupBy("event_date").agg(F.count(F.lit(1)).alias("files"))
    spread = spread.withColumn("event_date", F.col("event_date").cast("string"))
    return by_day(spark.read.parquet(path)).join(spread, "event_date")


@query
def folder_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, files and pressure of each day after two appends, from the files themselves."""
    events = stored_columns(inputs.canonical_events(spark, folder))
    path = _day_folders(spark, events, "folder-report", parts=2)
    found = folders.folder_report(spark, path, "event_date", slow=2, stop=3)
    return found.select("partition_name", "row_count", "files", "level", (F.col("data_bytes") > 0).alias("has_bytes"))


@query
def folder_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Files in storage against the manifest, after new days came and one old day was rewritten."""
    events = stored_columns(inputs.canonical_events(spark, folder))
    early, late = F.dayofmonth("event_date") <= 10, F.dayofmonth("event_date") > 10
    path = _day_folders(spark, events.where(early), "folder-audit")
    manifest = scratch_path(spark, "manifest")
    folders.register_files(spark, path, manifest)
    folders.write_days(events.where(late), path, "event_date", "user_id")
    one = events.where(F.dayofmonth("event_date") == 3)
    folders.rewrite_days(spark, path, folders.days_of(one, "event_date"), "event_date", "user_id", lambda rows: rows)
    found = folders.audit_files(spark, path, manifest)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query
def expired_from_footers(spark: SparkSession, folder: str) -> DataFrame:
    """The days of ``expired_partitions``, from the footers of the stored files; one date is missing on the 2nd."""
    events = inputs.canonical_events(spark, folder)
    early = F.least("eviction_date", F.date_add("event_date", 9))
    expires = F.when(F.dayofmonth("event_date") <= 12, early).otherwise(F.col("eviction_date"))
    rows = stored_columns(events).withColumn("eviction_date", expires)
    first = events.where(F.dayofmonth("event_date") == 2).agg(F.min("event_id")).first()[0]
    rows = rows.withColumn("eviction_date", F.when(~F.col("event_id").eqNullSafe(F.lit(first)), F.col("eviction_date")))
    path = _day_folders(spark, rows, "footers")
    both = None
    for inclusive in (True, False):
        found = folders.expired_days(spark, path, inputs.AS_OF, inclusive=inclusive).select(
            F.lit(inclusive).alias("inclusive"), F.col("event_date").cast("string").alias("event_date"),
            "partition_rows", F.col("last_eviction").cast("string").alias("last_eviction"),
        )
        both = found if both is None else both.unionByName(found)
    return both


@query
def delete_plan_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes that the deletion of each staged user rewrites, alone and shared with others."""
    events = inputs.canonical_events(spark, folder)
    path = _day_folders(spark, stored_columns(events), "delete-plan")
    plan = folders.delete_plan(spark, path, compliance.staged_ids(inputs.staging(events), inputs.AS_OF))
    return plan.select("user", "units", "shared_units", "shared_users", (F.col("bytes") > F.col("units") * 100).alias("has_bytes"))


@query
def rollup_sketch_users(spark: SparkSession, folder: str) -> DataFrame:
    """Users at three grains coarser than the stored rollup, from its sketches, against exact numbers."""
    events = inputs.canonical_events(spark, folder).withColumn("month", F.date_format("event_date", "yyyyMM"))
    grain = ["event_date", "month", "event_type"]
    path = scratch_path(spark, "sketches")
    rollup.rollup_with_sketch(events, grain).write.parquet(path)
    router = rollup.RollupRouter(events, spark.read.parquet(path), grain)
    out = None
    for dims in (["event_date"], ["month", "event_type"], ["month"]):
        name = F.concat_ws("/", *[F.col(d).cast("string") for d in dims]).alias("grain")
        got = router.answer(dims, ["event_count", "approx_users"]).select(name, "event_count", "approx_users")
        exact = events.groupBy(*dims).agg(F.count_distinct("user_id").alias("unique_users")).select(name, "unique_users")
        close = F.abs(F.col("approx_users") - F.col("unique_users")) <= 0.05 * F.col("unique_users")
        both = got.join(exact, "grain").select("grain", "event_count", "unique_users", close.alias("close"))
        out = both if out is None else out.unionByName(both)
    return out


@query
def decode_variant_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The nested messages of ``decode_json_paths``, parsed once each into a VARIANT."""
    kind = F.struct(F.col("event_type").alias("name"))
    body = F.struct(F.struct("event_id", "user_id", kind.alias("kind"), "props").alias("data"))
    raw = inputs.table(spark, folder, "events").select(F.to_json(body).alias("value"))
    paths = {"event_id": "$.data.event_id", "user_id": "$.data.user_id", "event_kind": "$.data.kind.name", "props": "$.data.props"}
    outer = decode.decode_variant(raw, "event_id BIGINT, user_id BIGINT, event_kind STRING, props STRING", paths=paths)
    inner = decode.decode_variant(outer.drop("_error", "value"), "k BIGINT", value="props")
    return inner.select("event_id", "user_id", "event_kind", "k")


@query
def sized_bucket_join(spark: SparkSession, folder: str) -> DataFrame:
    """Joins of bucketed tables of two sizes: each has as many buckets as its bytes need."""
    events = inputs.canonical_events(spark, folder).select("event_id", "user_id", "event_type", "cents")
    users = events.groupBy("user_id").agg(F.max("event_id").alias("last_event"))
    clicks = events.where("event_type = 'click'")
    per_bucket = joins.measured(events)[1] // 9 + 1
    pairs = [joins.BucketedPair.sized(rows, users, ["user_id"], per_bucket) for rows in (events, clicks)]
    more = joins.stored_buckets(spark, f"{pairs[0].prefix}_rows") > joins.stored_buckets(spark, f"{pairs[1].prefix}_rows")
    out = None
    for name, pair in zip(("all", "clicks"), pairs, strict=True):
        total = pair.join().agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("total_cents"), F.sum("last_event").alias("last_events"))
        total = total.select(F.lit(name).alias("rows_of"), "*", F.lit(more).alias("more_buckets"))
        out = total if out is None else out.unionByName(total)
    return out


@query
def table_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog table from create to drop: rows, and rows with the default state, after each step."""
    events = inputs.canonical_events(spark, folder)
    root = scratch_path(spark, "lifecycle")
    name = f"sediment_{root[-12:]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{root}'")
    table, steps = f"{name}.events", []

    def note(step: str) -> None:
        found = spark.table(table).agg(F.count(F.lit(1)), F.count_if(F.col("state") == "new")).first()
        steps.append((len(steps), step, *found))

    layout.create_table(spark, table, {"event_id": "BIGINT", "state": "STRING DEFAULT 'new'", "event_date": "DATE"}, ["event_date"])
    note("created")
    layout.insert_rows(events.where("event_id % 2 = 0").select("event_id", "event_date"), table)
    note("inserted with defaults")
    layout.insert_rows(events.where("event_id % 2 = 1").select("event_id", F.lit("old").alias("state"), "event_date"), table)
    note("inserted")
    layout.add_columns(spark, table, {"region": "STRING DEFAULT 'none'"})
    steps.append((len(steps), "column added", spark.table(table).where("region = 'none'").count(), 0))
    layout.empty_table(spark, table)
    note("emptied")
    layout.drop_table(spark, table)
    steps.append((len(steps), "dropped", int(spark.catalog.tableExists(table)), 0))
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.createDataFrame(steps, "step BIGINT, what STRING, n_rows BIGINT, n_new BIGINT")


@query
def two_phase_users(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and exact users per type: each task sends one row per type and user, not its rows."""
    events = inputs.canonical_events(spark, folder)
    counts = aggregates.distinct_by(events, ["event_type"], "user_id", "unique_users")
    totals = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cents").alias("total_cents"))
    return totals.join(counts, "event_type")

