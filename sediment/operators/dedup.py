"""Two deduplication contracts: by version, and by key with the newest arrival winning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SortKey = str | Column


def _first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # Spark trims each key to one row per map task before the shuffle (WindowGroupLimit), so a key
    # with very many copies sends one row per task and not all its copies.
    ranked = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def keep_latest_version(
    rows: DataFrame,
    key: Sequence[str],
    version: str,
    tiebreak: Sequence[SortKey],
    within: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the highest version, ties decided by ``tiebreak``.

    ``tiebreak`` is required because equal versions are common (the version is often derived from a
    key column) and the result has to be the same on every run. ``within`` limits the replacement to
    one partition, as background merging does: copies in different partitions both stay.
    """
    if not tiebreak:
        raise ValueError("a tie-break is required")
    ties = [F.col(t).asc() if isinstance(t, str) else t for t in tiebreak]
    return _first_per_key(rows, [*within, *key], [F.col(version).desc_nulls_last(), *ties])


def keep_latest_arrival(
    rows: DataFrame, key: Sequence[str], arrival: Sequence[str], unique: bool = False
) -> DataFrame:
    """One row per key: the one that arrived last.

    Rows with equal arrival are ordered by content, so that a rerun keeps the same one; ``unique``
    says that key and arrival identify a row and saves reading the content for that.
    """
    order = [F.col(a).desc_nulls_last() for a in arrival]
    if not unique:
        order.append(F.xxhash64(*rows.columns).desc())
    return _first_per_key(rows, key, order)


def upsert_rows(
    stored: DataFrame, batch: DataFrame, key: Sequence[str], arrival: Sequence[str]
) -> DataFrame:
    """Stored rows whose key is not in the batch, and the batch's newest row for each key.

    The key is global: a stored row is replaced even if the new one belongs to another day.
    """
    kept = stored.join(batch.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(keep_latest_arrival(batch, key, arrival))


def duplicate_rate(rows: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and the share of rows that deduplication removes."""
    per_key = rows.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("_copies"))
    counted = per_key.groupBy(*by).agg(
        F.sum("_copies").alias("rows_loaded"), F.count(F.lit(1)).alias("rows_stored")
    )
    removed = F.col("rows_loaded") - F.col("rows_stored")
    return counted.withColumn("rows_replaced", removed).withColumn(
        "duplicate_rate", F.round(removed / F.col("rows_loaded"), 6)
    )


def batch_fingerprints(rows: DataFrame, batch: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Content fingerprint of each batch, independent of row order."""
    return (
        rows.select(*batch, F.xxhash64(*content).alias("_h"))
        .groupBy(*batch)
        .agg(
            F.count(F.lit(1)).alias("batch_rows"),
            F.bit_xor("_h").alias("hash_xor"),
            F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        )
    )


FINGERPRINT = ["batch_rows", "hash_xor", "hash_sum"]


def live_ledger(ledger: DataFrame, as_of: Column, last: int | None = None, days: int = 7) -> DataFrame:
    """Ledger entries that still block a repeat: none older than ``days``; on request the newest ``last``."""
    recent = ledger.where(
        (F.col("accepted_at") <= as_of) & (F.col("accepted_at") > as_of - F.expr(f"INTERVAL {days} DAYS"))
    )
    if last is None:
        return recent
    order = [F.col("accepted_at").desc(), *[F.col(c) for c in FINGERPRINT]]
    return recent.orderBy(*order).limit(last)


LEDGER_SCHEMA = (
    "accepted_on DATE, accepted_at TIMESTAMP, batch_rows BIGINT, hash_xor BIGINT, hash_sum STRING"
)


def unseen_batches(incoming: DataFrame, live: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Incoming batches not in the live ledger; of repeats within ``incoming`` the first arrival."""
    first = _first_per_key(incoming, FINGERPRINT, [F.col(a).asc() for a in arrival])
    return first.join(live.select(*FINGERPRINT), FINGERPRINT, "left_anti")
