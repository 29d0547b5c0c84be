"""Queries over sources, decoding and column mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import times
from sediment.operators import reports
from sediment.plans import inputs
from sediment.plans.registry import query
from sediment.session import scratch_path
from sediment.sources import decode, feeds, files, messages

START_OFFSETS = {0: 600, 1: 1, 2: 0, 3: 3000, 4: 10, 5: 9000}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query
def replay_from_offsets(spark: SparkSession, folder: str) -> DataFrame:
    log = inputs.messages(inputs.canonical_events(spark, folder))
    return (
        messages.from_offsets(log, START_OFFSETS)
        .groupBy("partition")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
        )
    )


@query
def decode_json_paths(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.struct(F.col("event_type").alias("name"))
    body = F.struct(F.struct("event_id", "user_id", kind.alias("kind")).alias("data"))
    raw = inputs.table(spark, folder, "events").select(F.to_json(body).alias("value"), "props")
    outer = decode.decode_json(
        raw,
        "event_id BIGINT, user_id BIGINT, event_kind STRING",
        paths={"event_kind": "$.kind.name"},
        root="$.data",
    ).drop("_error")
    return decode.decode_json(outer, "k BIGINT", value="props").select("event_id", "user_id", "event_kind", "k")


@query
def decode_json_array(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    halves = F.array(
        *[F.struct("event_id", F.lit(p).alias("half"), (F.col("cents") * p).alias("amount")) for p in (1, 2)]
    )
    raw = events.select(F.to_json(halves).alias("value"))
    rows = decode.decode_json(raw, "event_id BIGINT, half INT, amount BIGINT", outer_array=True)
    return rows.where("_error IS NULL").select("event_id", F.col("half").cast("bigint").alias("half"), "amount")


@query
def decode_csv_positional(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as 29-column crash lines and read back by position."""
    ts = F.col("ts").cast("timestamp")
    value = F.col("value").cast("decimal(12,2)").cast("string")
    known = {
        0: F.date_format(ts, "MM/dd/yyyy"),
        1: F.date_format(ts, "H:mm"),
        2: F.concat(F.lit("type, "), F.col("event_type")),
        3: F.col("user_id").cast("string"),
        4: value,
        5: F.concat(F.lit("-"), value),
        6: F.concat(F.lit("("), value, F.lit(", -"), value, F.lit(")")),
        23: F.col("event_id").cast("string"),
    }
    cells = [known.get(i, F.lit("x")).alias(f"c{i}") for i in range(feeds.CRASH_WIDTH)]
    raw = inputs.table(spark, folder, "events").select(F.to_csv(F.struct(*cells)).alias("value"))
    rows = decode.decode_csv(
        raw,
        feeds.CRASH_SCHEMA,
        feeds.positional(feeds.CRASH_WIDTH, feeds.CRASH_POSITIONS),
        derived=feeds.crash_derived(),
    )
    return rows.where("_error IS NULL").select(
        F.col("COLLISION_ID").cast("bigint").alias("collision_id"),
        times.timestamp_text(F.col("CRASH_DATE")).alias("crash_at"),
        F.col("BOROUGH").alias("borough"),
        F.col("ZIP_CODE").alias("zip_code"),
        F.col("LATITUDE").cast("bigint").alias("latitude"),
        F.col("LONGITUDE").cast("bigint").alias("longitude"),
        F.col("LOCATION").alias("location"),
    )


@query
def roundtrip_formats(spark: SparkSession, folder: str) -> DataFrame:
    schema = "event_id BIGINT, user_id BIGINT, event_date DATE, event_type STRING, cents BIGINT"
    events = inputs.canonical_events(spark, folder).select("event_id", "user_id", "event_date", "event_type", "cents")
    root = scratch_path(spark, "formats")
    out = None
    for fmt in files.FORMATS:
        events.write.format(fmt).save(f"{root}/{fmt}")
        back = files.read_files(spark, [f"{root}/{fmt}"], fmt, schema)
        line = back.groupBy(F.lit(fmt).alias("format"), F.col("event_date").cast("string").alias("event_date")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("cents").alias("total_cents"),
            F.count_distinct("user_id").alias("n_users"),
        )
        out = line if out is None else out.unionByName(line)
    return out


def _file_list(events: DataFrame) -> DataFrame:
    """One file per day and bucket of the events, last modified at its newest event."""
    bucket = F.col("event_id") % 21
    path = F.concat_ws("/", F.lit("events"), F.col("event_date").cast("string"), F.concat(F.lit("part-"), bucket))
    return events.groupBy(path.alias("path"), bucket.alias("bucket"), "event_date").agg(
        F.max("ts").alias("last_modified"), F.count(F.lit(1)).alias("n_rows")
    )


def _ledger(listing: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("bucket") % 5 == 0, "ERROR").when(F.col("bucket") % 5 == 1, "LOADING").otherwise("LOADED")
    )
    first = listing.select(
        "path",
        state.alias("state"),
        F.date_add("event_date", 1).cast("timestamp").alias("loaded_at"),
        "last_modified",
        F.lit(None).cast("string").alias("error"),
    )
    retried = (
        listing.where("bucket % 10 = 0")
        .select(
            "path",
            F.lit("LOADED").alias("state"),
            F.date_add("event_date", 2).cast("timestamp").alias("loaded_at"),
            "last_modified",
            F.lit(None).cast("string").alias("error"),
        )
    )
    return first.unionByName(retried)


@query
def files_to_load(spark: SparkSession, folder: str) -> DataFrame:
    listing = _file_list(inputs.canonical_events(spark, folder))
    ledger = _ledger(listing)
    as_of = F.lit(inputs.AS_OF).cast("timestamp")
    once = files.files_to_load(listing, ledger).select(F.lit("once").alias("mode"), "path")
    again = files.files_to_load(listing, ledger, as_of, 7)
    return once.unionByName(again.select(F.lit("seven days").alias("mode"), "path"))


@query
def failed_files_recent(spark: SparkSession, folder: str) -> DataFrame:
    ledger = _ledger(_file_list(inputs.canonical_events(spark, folder)))
    failed = files.failed_files(files.current_file_states(ledger))
    return failed.select("path", times.timestamp_text(F.col("last_modified")).alias("last_modified"))


@query
def generate_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """One generated click per event; the shares of the sites and the lateness follow the feed's rule."""
    events = inputs.table(spark, folder, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    made = messages.click_messages(events, "event_id", seconds)
    return made.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_clicks"),
        F.count_distinct("uid").alias("n_users"),
        F.sum("vtime").alias("sum_vtime"),
        F.max("late_seconds").alias("most_late"),
        F.min("late_seconds").alias("least_late"),
    )


def _broken_props(spark: SparkSession, folder: str) -> DataFrame:
    cut = F.expr("substring(props, 1, length(props) - 1)")
    value = F.when(F.col("event_id") % 50 == 0, cut).otherwise(F.col("props"))
    return inputs.table(spark, folder, "events").select("event_id", "user_id", "event_type", value.alias("value"))


@query
def split_good_bad(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides counted in one pass over the messages."""
    decoded = decode.decode_json(_broken_props(spark, folder), "k BIGINT")
    return decoded.groupBy(decode.side().alias("side")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("sum_k")
    )


@query
def load_job_counters(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decode.decode_json(_broken_props(spark, folder), "k BIGINT")
    return decode.load_counters(decoded, F.col("user_id") > 5, ["event_type"])


@query
def strict_cast_rejects(spark: SparkSession, folder: str) -> DataFrame:
    readings = inputs.readings(inputs.canonical_events(spark, folder))
    raw = readings.select(
        F.to_date("ts").cast("string").alias("day"),
        "metric",
        F.col("metric").alias("loose"),
        F.lit(None).cast("string").alias("_error"),
    )
    lenient = decode.cast_fields(raw, "loose DOUBLE", strict=False)
    return decode.cast_fields(lenient, "metric DOUBLE", strict=True).groupBy("day").agg(
        F.count_if(F.col("_error").isNull()).alias("accepted_rows"),
        F.count_if(F.col("_error").isNotNull()).alias("rejected_rows"),
        F.count(F.lit(1)).alias("lenient_rows"),
        F.count_if(F.col("loose").isNull()).alias("lenient_nulls"),
    )


@query
def derive_event_date(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    return events.select("event_id", "event_ts", F.col("event_date").cast("string").alias("event_date"))


@query
def map_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The stored columns of the versioned table, in its order."""
    return inputs.canonical_events(spark, folder).select(
        F.col("event_date").cast("string").alias("event_date"),
        "event_ts",
        "user_id",
        F.col("eviction_date").cast("string").alias("eviction_date"),
        F.col("event_ts").alias("row_version"),
        F.lit("topic").alias("loaded_from"),
    )


@query
def table_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.table_row_counts({name: inputs.table(spark, folder, name) for name in TABLES})


@query
def consumer_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Each event type stands for a group that committed its own last message of a partition."""
    sent = inputs.messages(inputs.canonical_events(spark, folder))
    topic = F.concat_ws("-", "topic", (F.col("partition") % 2).cast("string"))
    group = F.get_json_object("value", "$.event_type")
    log = sent.select(topic.alias("topic"), "partition", "offset", group.alias("group_id"))
    ends = log.groupBy("topic", "partition").agg(F.max("offset").alias("end_offset"))
    committed = (
        log.groupBy("group_id", "topic", "partition")
        .agg(F.max("offset").alias("committed_offset"))
        .where("NOT (group_id = 'view' AND partition = 5)")
    )
    return reports.consumer_lag(ends, committed)
