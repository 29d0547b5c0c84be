"""Deletes, updates and their proof."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.operators import compliance
from sediment.plans import inputs
from sediment.plans.registry import query
from sediment.plans.tables import STORED, by_day, stored_columns
from sediment.session import scratch_path
from sediment.sources.day_table import DayTable

ONE_USER = 8


def _events_and_staging(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = inputs.canonical_events(spark, folder)
    return events, inputs.staging(events)


def _stored(spark: SparkSession, events: DataFrame, label: str) -> DayTable:
    table = DayTable(spark, scratch_path(spark, label), STORED, ["event_id"], sort=["user_id"])
    table.append(stored_columns(events))
    return table


def _text_dates(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "user_id", F.col("eviction_date").cast("string").alias("eviction_date"))


@query
def delete_user(spark: SparkSession, folder: str) -> DataFrame:
    """One user deleted from the stored table; only the days with the user are rewritten."""
    events = inputs.canonical_events(spark, folder)
    table = _stored(spark, events, "delete")
    ids = events.where(F.col("user_id") == ONE_USER).select("user_id").distinct()
    compliance.delete_users(table, ids)
    return by_day(table.read())


@query
def rows_matching_batch(spark: SparkSession, folder: str) -> DataFrame:
    events, staging = _events_and_staging(spark, folder)
    ids = compliance.staged_ids(staging, inputs.AS_OF)
    return compliance.matching(events, ids).select("event_id", "user_id")


@query
def survivors_after_delete(spark: SparkSession, folder: str) -> DataFrame:
    events, staging = _events_and_staging(spark, folder)
    ids = compliance.staged_ids(staging, inputs.AS_OF)
    return by_day(compliance.survivors(events, ids))


@query
def update_where(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    changed = compliance.update_where(
        events, F.col("user_id") == ONE_USER, {"eviction_date": F.lit(inputs.AS_OF).cast("date")}
    )
    return _text_dates(changed)


@query
def update_from_staging(spark: SparkSession, folder: str) -> DataFrame:
    events, staging = _events_and_staging(spark, folder)
    return _text_dates(compliance.update_from(events, compliance.staged_updates(staging, inputs.AS_OF)))


@query
def staging_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    _, staging = _events_and_staging(spark, folder)
    found = compliance.conflicting_updates(compliance.staged_updates(staging, inputs.AS_OF))
    return found.withColumn("new_eviction_date", F.col("new_eviction_date").cast("string"))


@query
def withdraw_consent(spark: SparkSession, folder: str) -> DataFrame:
    events, staging = _events_and_staging(spark, folder)
    ids = compliance.staged_ids(staging, inputs.AS_OF, "UPDATE")
    given = events.withColumn("consent_status", F.lit("given"))
    return compliance.withdraw_consent(given, ids).select("event_id", "consent_status")


@query
def pseudonymize(spark: SparkSession, folder: str) -> DataFrame:
    events = inputs.canonical_events(spark, folder)
    blanked = compliance.pseudonymize(events, F.col("user_id") == ONE_USER, salt="pepper:")
    return blanked.select(
        "event_id",
        F.coalesce("user_id", F.lit(-1)).alias("user_id"),
        F.coalesce("user_token", F.lit("none")).alias("user_token"),
    )


@query
def delete_impact_plan(spark: SparkSession, folder: str) -> DataFrame:
    events, staging = _events_and_staging(spark, folder)
    ids = compliance.staged_ids(staging, inputs.AS_OF)
    return compliance.delete_impact(events, ids, "event_date", F.col("user_id") % 7)


@query
def physical_removal_check(spark: SparkSession, folder: str) -> DataFrame:
    """After the delete and the clean-up no file, current or superseded, holds a deleted user."""
    events, staging = _events_and_staging(spark, folder)
    ids = compliance.staged_ids(staging, inputs.AS_OF)
    table = _stored(spark, events, "removal")
    compliance.delete_users(table, ids)
    count = F.count(F.lit(1))
    before = compliance.matching(events, ids).groupBy("user_id").agg(count.alias("rows_before"))
    superseded = compliance.stored_rows_of(table, ids).groupBy("user_id").agg(count.alias("rows_in_files"))
    # Written, not cached: a cached plan over the same folder would also answer the count below.
    kept = scratch_path(spark, "superseded")
    superseded.write.parquet(kept)
    superseded = spark.read.parquet(kept)
    table.vacuum()
    live = compliance.matching(table.read(), ids).groupBy("user_id").agg(count.alias("rows_live"))
    left = compliance.stored_rows_of(table, ids).groupBy("user_id").agg(count.alias("rows_left"))
    joined = before.join(superseded, "user_id", "left").join(live, "user_id", "left").join(left, "user_id", "left")
    return joined.na.fill(0, ["rows_in_files", "rows_live", "rows_left"])


@query
def nightly_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The whole night: staged deletes and updates on the stored table, evidence, empty staging."""
    events, staged = _events_and_staging(spark, folder)
    table = _stored(spark, events, "nightly")
    staging = DayTable(spark, scratch_path(spark, "staging"), compliance.STAGING_SCHEMA, day="batch_date")
    staging.append(staged)
    evidence = DayTable(spark, scratch_path(spark, "evidence"), compliance.EVIDENCE_SCHEMA, day="batch_date")
    compliance.nightly_batch(table, staging, evidence, inputs.AS_OF)
    kept = table.read().groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("eviction_date").cast("string").alias("last_eviction")
    )
    proven = evidence.read().select("user_id", F.lit(0).cast("bigint").alias("n_rows"), F.lit("removed").alias("last_eviction"))
    return kept.unionByName(proven)


@query
def sla_report(spark: SparkSession, folder: str) -> DataFrame:
    _, staging = _events_and_staging(spark, folder)
    start = F.lit(inputs.AS_OF).cast("timestamp")
    taken = F.make_dt_interval(hours=F.col("user_id") % 40)
    evidence = compliance.staged_ids(staging, inputs.AS_OF).select(
        "user_id",
        start.alias("requested_at"),
        start.alias("deleted_at"),
        F.when(F.col("user_id") % 75 != 0, start + taken).alias("removed_at"),
    )
    report = compliance.sla_report(evidence)
    return report.select("user_id", F.coalesce("hours_taken", F.lit(-1.0)).alias("hours_taken"), "within_sla")
