"""Token ids as Parquet list columns with dictionary pages, sized row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.common import scratch_path
from sediment.llm.packing import part_starts, tokenised

END = 2
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2_000


def write(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END,
    tokenizer: str | None = None,
    row_group: int = ROW_GROUP,
) -> None:
    """Write ``id, part, before, n_tokens, tokens`` for every row, in ascending order of the id.

    Rows are dealt over tasks by ranges of (id, hash of the text) and sorted there, so a repeated id
    can be split. Null ids come first; null and empty texts have the token ``end`` only. Each task
    encodes and writes its range as one or more files. Ids are stored as a list of 32-bit integers
    with a dictionary (a vocabulary's ids fit into one dictionary page), the sorted numbers in
    DELTA_BINARY_PACKED pages without a dictionary. Page indexes hold the least and largest id of
    every page, so a reader that wants some ids or no tokens skips the rest.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first(), "tie")
    dealt = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group,
        "parquet.page.size": PAGE,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": 1 << 20,
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("id", "before", "n_tokens")},
    }
    tokenised(dealt, "id", "text", end, tokenizer).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """``id, start, n_tokens`` and the ``tokens`` on request; start counts the ids of all earlier rows.

    Filters on ``id`` reach the row groups and pages; without ``tokens`` their column is not read.
    """
    table = spark.read.parquet(path)
    # One row for each file's task, as many as the driver keeps in its own list of tasks.
    placed = table.join(F.broadcast(part_starts(table)), "part")
    start = (F.col("part_start") + F.col("before")).alias("start")
    return placed.select("id", start, "n_tokens", *["tokens"] * tokens)


def checksums(rows: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32``: crc32 of the ids as little-endian 32-bit integers."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "n_tokens", "ids_crc32"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = np.asarray(lists.offsets).tolist()
            flat = np.asarray(lists.values).astype("<u4", copy=False)
            found = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], names)

    return rows.select("id", "start", "n_tokens", "tokens").mapInArrow(
        sums, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Write all rows to files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write(docs, path, **how)
    return read(spark, path)
