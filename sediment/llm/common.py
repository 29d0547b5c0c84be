"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.session import scratch_path, shared_root

#: Text that one step of a Python worker handles at once. A longer document is a step of its own.
STEP_BYTES = 4 << 20

#: The separators of words: U+0020 and U+0009 to U+000D, as ``bytes.split`` has them.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """``checkpoint()`` in the folder of ``spark.checkpoint.dir``."""
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return frame.checkpoint()


def free_name(frame: DataFrame, base: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fold_number(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def steps(batch: pa.RecordBatch, text: int = 1, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(lengths):
        if row > start and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if batch.num_rows > start:
        yield batch.slice(start)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def numbered_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, the number of each word of all texts, where each text starts and ends)."""
    seen = Numbers()
    pieces, ends = [], [0]
    for text in texts:
        words = text.split() if text else []
        pieces.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
        ends.append(ends[-1] + len(words))
    numbers = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    return list(seen), numbers, np.asarray(ends, np.int64)
