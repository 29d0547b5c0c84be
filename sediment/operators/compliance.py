"""Deletes and updates by user, the plan of their cost, and the proof that they took effect."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.operators.joins import lookup_join
from sediment.sources.day_table import DayTable

# Columns of the staging table.
STAGING_SCHEMA = "batch_date DATE, operation STRING, user_id BIGINT, new_eviction_date DATE"
SLA_HOURS = 24


def staged_ids(staging: DataFrame, batch_date: str, operation: str = "DELETE") -> DataFrame:
    chosen = (F.col("batch_date") == F.lit(batch_date).cast("date")) & (F.col("operation") == operation)
    return staging.where(chosen).select("user_id").distinct()


def staged_updates(staging: DataFrame, batch_date: str) -> DataFrame:
    """One new eviction date per user: the latest; ``requests`` shows where several were staged."""
    chosen = (
        (F.col("batch_date") == F.lit(batch_date).cast("date"))
        & (F.col("operation") == "UPDATE")
        & F.col("new_eviction_date").isNotNull()
    )
    return staging.where(chosen).groupBy("user_id").agg(
        F.max("new_eviction_date").alias("new_eviction_date"), F.count(F.lit(1)).alias("requests")
    )


def conflicting_updates(updates: DataFrame) -> DataFrame:
    return updates.where("requests > 1")


def matching(rows: DataFrame, ids: DataFrame, spread: str | None = None) -> DataFrame:
    return lookup_join(rows, ids, ["user_id"], "left_semi", spread)


def survivors(rows: DataFrame, ids: DataFrame, spread: str | None = None) -> DataFrame:
    """Rows left after the users in ``ids`` are deleted."""
    return lookup_join(rows, ids, ["user_id"], "left_anti", spread)


def without_user(rows: DataFrame, user_id: int) -> DataFrame:
    return rows.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def update_where(rows: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    met = F.coalesce(condition, F.lit(False))
    return rows.withColumns({n: F.when(met, v).otherwise(F.col(n)) for n, v in values.items()})


def update_from(rows: DataFrame, updates: DataFrame, spread: str | None = None) -> DataFrame:
    """Set ``eviction_date`` of the users that have a staged one."""
    columns = rows.columns
    joined = lookup_join(rows, updates.select("user_id", "new_eviction_date"), ["user_id"], "left", spread)
    changed = F.coalesce("new_eviction_date", "eviction_date")
    return joined.withColumn("eviction_date", changed).select(*columns)


def withdraw_consent(
    rows: DataFrame, ids: DataFrame, column: str = "consent_status", spread: str | None = None
) -> DataFrame:
    flagged = ids.distinct().withColumn("_withdrawn", F.lit(True))
    joined = lookup_join(rows, flagged, ["user_id"], "left", spread)
    value = F.when(F.col("_withdrawn"), F.lit("withdrawn")).otherwise(F.col(column))
    return joined.withColumn(column, value).drop("_withdrawn")


def pseudonymize(rows: DataFrame, condition: Column, salt: str | None = None) -> DataFrame:
    """Blank the user of matching rows; with a salt, put a keyed hash into ``user_token`` as well."""
    out = rows
    if salt is not None:
        token = F.sha2(F.concat(F.lit(salt), F.col("user_id").cast("string")), 256)
        out = out.withColumn("user_token", F.when(condition, token))
    return update_where(out, condition, {"user_id": F.lit(None).cast("bigint")})


def delete_impact(rows: DataFrame, ids: DataFrame, day: str, bucket: Column) -> DataFrame:
    """Storage units (day and bucket) rewritten by deletes: per user, one by one, and as a batch.

    Handled one user after another, a unit that several users share is rewritten several times; as
    one batch it is rewritten once.
    """
    units = matching(rows, ids).select("user_id", day, bucket.alias("bucket")).distinct()
    per_user = units.groupBy("user_id").agg(F.count(F.lit(1)).alias("units"))
    shared = units.groupBy(day, "bucket").agg(F.count(F.lit(1)).alias("users"))
    totals = shared.agg(
        F.coalesce(F.sum("users"), F.lit(0)).alias("serial"), F.count(F.lit(1)).alias("merged")
    )
    lines = F.array(
        F.struct(F.lit("one by one").alias("scope"), F.col("serial").alias("units")),
        F.struct(F.lit("as a batch").alias("scope"), F.col("merged").alias("units")),
    )
    users = per_user.select(F.concat(F.lit("user "), F.col("user_id")).alias("scope"), "units")
    return users.unionByName(totals.select(F.inline(lines)))


def stored_rows_of(table: DayTable, ids: DataFrame) -> DataFrame:
    """Rows of the users in any file under the table, current or superseded, by file."""
    found = (
        table.spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(table.root)
        .select("user_id", F.col("_metadata.file_path").alias("file"))
    )
    return matching(found, ids)


def _spread(table: DayTable) -> str | None:
    """A column that differs between rows of one user."""
    return table.key[0] if table.key else None


def delete_users(table: DayTable, ids: DataFrame, token: tuple[str, int] | None = None) -> list[str]:
    """Delete users from a table. Only days that hold them are rewritten, all users at once."""
    table.fold()
    touched = table.days_with(ids, ["user_id"])
    table.rewrite(lambda rows: survivors(rows, ids, _spread(table)), touched, token)
    return sorted(touched)


def update_users(table: DayTable, updates: DataFrame, token: tuple[str, int] | None = None) -> list[str]:
    table.fold()
    touched = table.days_with(updates.select("user_id"), ["user_id"])
    table.rewrite(lambda rows: update_from(rows, updates, _spread(table)), touched, token)
    return sorted(touched)


def nightly_batch(
    table: DayTable, staging: DayTable, evidence: DayTable, batch_date: str, physical: bool = True
) -> list[str]:
    """The date's staged deletes and updates, removal of old files, check, evidence, then unstage the date.

    With ``physical`` every file below the table is searched for the deleted users, and a find raises;
    the evidence has the times at which rows went and at which the files were found clean. Requests
    of other dates stay staged. Returns the days that were rewritten. Run again after a failure it
    does the same work or none.
    """
    staged = staging.read()
    ids = staged_ids(staged, batch_date).persist()
    updates = staged_updates(staged, batch_date).persist()
    try:
        table.fold()
        affected = ids.union(updates.select("user_id")).distinct()
        touched = table.days_with(affected, ["user_id"])
        # One rewrite of each day for both kinds of request.
        spread = _spread(table)
        table.rewrite(lambda rows: update_from(survivors(rows, ids, spread), updates, spread), touched)
        left = table.days_with(ids, ["user_id"])
        if left:
            raise RuntimeError(f"deleted users are still visible on {sorted(left)}")
        deleted_at = _now()
        if physical:
            table.vacuum()
            kept = stored_rows_of(table, ids).select("file").distinct().limit(5).collect() if table.holds_files() else []
            if kept:
                raise RuntimeError(f"deleted users are still in files: {[r['file'] for r in kept]}")
        removed_at = _now() if physical else None
        entries = ids.select(
            F.lit(batch_date).cast("date").alias("batch_date"),
            "user_id",
            F.lit(batch_date).cast("timestamp").alias("requested_at"),
            F.lit(deleted_at).cast("timestamp").alias("deleted_at"),
            F.lit(removed_at).cast("timestamp").alias("removed_at"),
        )
        known = evidence.read().select("batch_date", "user_id")
        evidence.append(entries.join(known, ["batch_date", "user_id"], "left_anti"))
        if staging.day == "batch_date":
            staging.drop_days([batch_date])
        else:
            day = F.lit(batch_date).cast("date")
            staging.rewrite(lambda rows: rows.where(~F.col("batch_date").eqNullSafe(day)), staging.days())
        if physical:
            staging.vacuum()
    finally:
        ids.unpersist()
        updates.unpersist()
    return sorted(touched)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


EVIDENCE_SCHEMA = (
    "batch_date DATE, user_id BIGINT, requested_at TIMESTAMP, deleted_at TIMESTAMP, removed_at TIMESTAMP"
)


def sla_report(evidence: DataFrame, hours: int = SLA_HOURS) -> DataFrame:
    """Hours from request to physical removal, and whether that is within the limit."""
    took = (F.unix_seconds("removed_at") - F.unix_seconds("requested_at")) / 3600
    return evidence.withColumn("hours_taken", F.round(took, 6)).withColumn(
        "within_sla", F.coalesce(F.col("hours_taken") <= hours, F.lit(False))
    )
