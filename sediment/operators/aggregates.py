"""Counts, distinct counts, time buckets, ratios and mergeable aggregate states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions import numbers, sketches


def count_by(rows: DataFrame, by: Sequence[str], name: str, most: int | None = None) -> DataFrame:
    """Rows per value, largest first; ``most`` keeps the top of the list."""
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    ordered = counted.orderBy(F.col(name).desc(), *by)
    return ordered if most is None else ordered.limit(most)


def distinct_by(rows: DataFrame, by: Sequence[str], of: str, name: str) -> DataFrame:
    counted = rows.groupBy(*by).agg(F.count_distinct(of).alias(name))
    return counted.orderBy(F.col(name).desc(), *by)


def approximate_distinct_by(
    rows: DataFrame, by: Sequence[str], of: str, error: float = 0.02, precision: int = 14
) -> DataFrame:
    """Two approximations of different cost next to the exact count."""
    return rows.groupBy(*by).agg(
        F.approx_count_distinct(of, error).alias("approx_users"),
        sketches.sketch_count(sketches.user_sketch(F.col(of), precision)).alias("sketch_users"),
        F.count_distinct(of).alias("exact_users"),
    )


def count_by_bucket(
    rows: DataFrame, bucket: Column, measures: dict[str, Column], most: int, latest: bool
) -> DataFrame:
    """Aggregates per time bucket: the latest ``most`` buckets, or the first."""
    grouped = rows.groupBy(bucket.alias("bucket")).agg(*[c.alias(n) for n, c in measures.items()])
    order = F.col("bucket").desc() if latest else F.col("bucket").asc()
    return grouped.orderBy(order).limit(most)


def hit_ratio(rows: DataFrame, by: Sequence[str], hit: Column, miss: Column) -> DataFrame:
    counted = rows.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"))
    return counted.withColumn("hit_rate_pct", numbers.percentage(F.col("hits"), F.col("misses")))


def per_row_average(rows: DataFrame, by: Sequence[str], size: Column) -> DataFrame:
    """Weighted ratio: total size by total rows."""
    summed = rows.groupBy(*by).agg(
        F.sum(size).cast("bigint").alias("total_size"), F.count(F.lit(1)).alias("total_rows")
    )
    return summed.withColumn("size_per_row", F.round(F.col("total_size") / F.col("total_rows"), 6))


def aggregate_states(rows: DataFrame, dims: Sequence[str], value: Column, user: str) -> DataFrame:
    """States that can be merged later: count, sum, min, max and a sketch of the users."""
    return rows.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        sketches.user_sketch(F.col(user), 14).alias("users"),
    )


def merge_states(stored: DataFrame, new: DataFrame, dims: Sequence[str]) -> DataFrame:
    return (
        stored.unionByName(new)
        .groupBy(*dims)
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            sketches.sketch_union(F.col("users")).alias("users"),
        )
    )


def read_states(states: DataFrame, dims: Sequence[str]) -> DataFrame:
    return states.select(
        *dims, "n", "total", "low", "high", sketches.sketch_count(F.col("users")).alias("users")
    )
