"""Each scalar function family over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import numbers, text, times
from sediment.plans import inputs
from sediment.plans.registry import query


@query
def scalar_dates(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    ts = F.col("ts")
    us_date, us_time = F.date_format(ts, "M/d/yyyy"), F.date_format(ts, "H:mm")
    return events.select(
        "event_id",
        times.timestamp_text(times.hour_of(ts)).alias("hour"),
        times.hour_label(ts).alias("label"),
        times.timestamp_text(times.from_us_date_and_time(us_date, us_time)).alias("parsed"),
        F.coalesce(
            times.timestamp_text(times.from_us_date_and_time(F.col("event_type"), us_time)), F.lit("none")
        ).alias("not_parsed"),
        times.timestamp_text(times.hour_from_seconds(F.floor(F.col("event_ts") / 1000))).alias("from_seconds"),
        F.date_format(F.timestamp_millis("event_ts"), "yyyy-MM-dd HH:mm:ss.SSS").alias("millis"),
        times.day_number(ts).cast("bigint").alias("day_number"),
        times.month_number(ts).cast("bigint").alias("month_number"),
        times.timestamp_text(times.interval_start(ts, 900)).alias("quarter_hour"),
        times.plus_days(F.col("event_date"), 90).cast("string").alias("plus_90"),
    )


@query
def scalar_time_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Half-hour slots covered by each event for as many minutes as its value."""
    events = inputs.canonical_events(spark, folder)
    seconds = F.floor(F.col("cents") * 60 / 100)
    slots = events.select(F.explode(times.slots_covered(F.col("ts"), seconds, 1800)).alias("slot"))
    counted = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n_events"))
    return counted.select(times.timestamp_text(F.col("slot")).alias("slot"), "n_events")


@query
def scalar_numbers(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    signed = F.col("value") - 50
    return events.select(
        "event_id",
        F.round("value", 1).alias("rounded"),
        numbers.cut_decimals(F.col("value"), 1).alias("cut"),
        numbers.cut_decimals(signed, 0).alias("cut_signed"),
        F.pmod(F.col("user_id"), F.lit(7)).alias("remainder"),
        F.coalesce(numbers.lenient_double(F.regexp_replace("event_type", "^[a-m].*", "12.5")), F.lit(-1.0)).alias("as_number"),
        F.when(F.col("cents") > 2000, "large").otherwise("small").alias("size_class"),
    )


@query
def scalar_strings(spark: SparkSession, folder: str) -> DataFrame:
    documents = inputs.table(spark, folder, "documents")
    body = F.col("text")
    return documents.select(
        "doc_id",
        F.length(body).cast("bigint").alias("n_chars"),
        F.concat_ws("-", "lang", "source").alias("origin"),
        F.concat(F.col("lang"), F.lit(":"), F.col("doc_id").cast("string")).alias("label"),
        text.first_match(body, "[0-9]+").alias("first_number"),
        text.match_count(body, "[aeiou]").cast("bigint").alias("vowels"),
        text.edit_distance(F.col("lang"), F.col("source")).cast("bigint").alias("distance"),
        F.md5(text.hex_text(body)).alias("hex_md5"),
        F.md5(text.base64_text(body)).alias("base64_md5"),
    )


@query
def scalar_json(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.table(spark, folder, "events")
    return events.select("event_id", text.json_field(F.col("props"), "$.k").cast("bigint").alias("k"))


@query
def readable_size(spark: SparkSession, folder: str) -> DataFrame:
    documents = inputs.table(spark, folder, "documents")
    steps = F.array(*[F.lit(s) for s in (1, 1000, 1_000_000, 1_000_000_000)])
    sized = documents.select("doc_id", F.explode(steps).alias("factor"), F.length("text").alias("n"))
    size = F.col("n") * F.col("factor").cast("bigint")
    return sized.select("doc_id", size.alias("bytes"), numbers.readable_size(size).alias("readable"))
