"""Mergeable counts of distinct values: bitmaps (exact, integers) and HLL sketches (approximate).

A bitmap covers 32,768 consecutive ids, so every aggregation also groups by the bucket of the id;
one group therefore holds at most one 4 KiB buffer, however many rows share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_sketch(value: Column, precision: int = 12) -> Column:
    return F.hll_sketch_agg(value, precision)


def sketch_union(sketch: Column) -> Column:
    return F.hll_union_agg(sketch)


def sketch_count(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def id_bitmaps(rows: DataFrame, groups: list[str], id_column: str) -> DataFrame:
    """One bitmap per group and id bucket: ``groups, bucket, bitmap``."""
    bucketed = rows.where(F.col(id_column).isNotNull()).select(
        *groups,
        F.bitmap_bucket_number(id_column).alias("bucket"),
        F.bitmap_bit_position(id_column).alias("_bit"),
    )
    return bucketed.groupBy(*groups, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))


def union_bitmaps(bitmaps: DataFrame, groups: list[str]) -> DataFrame:
    return bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_cardinality(bitmaps: DataFrame, groups: list[str], name: str) -> DataFrame:
    return bitmaps.groupBy(*groups).agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias(name))


def set_sizes(bitmaps: DataFrame, set_column: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Size of the intersection and of the union for the pairs of sets the caller names.

    ``bitmaps`` comes from ``id_bitmaps(rows, [set_column], id)``. A bitmap is copied once per pair
    that names its set; rows are never paired with rows.
    """
    named = F.array(
        *[F.struct(F.lit(a).alias("left_set"), F.lit(b).alias("right_set")) for a, b in pairs]
    )
    own = F.filter(
        named, lambda p: (p["left_set"] == F.col(set_column)) | (p["right_set"] == F.col(set_column))
    )
    per_bucket = (
        bitmaps.select("bucket", "bitmap", F.explode(own).alias("pair"))
        .groupBy("pair", "bucket")
        .agg(
            F.bitmap_and_agg("bitmap").alias("common"),
            F.bitmap_or_agg("bitmap").alias("either"),
            F.count(F.lit(1)).alias("present"),
        )
    )
    in_both = F.when(F.col("present") == 2, F.bitmap_count("common")).otherwise(F.lit(0))
    return per_bucket.groupBy("pair.left_set", "pair.right_set").agg(
        F.sum(in_both).cast("bigint").alias("in_both"),
        F.sum(F.bitmap_count("either")).cast("bigint").alias("in_either"),
    )
