"""Concatenate all documents' tokens and cut them into sequences of equal length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.common import steps, stored, texts_of
from sediment.llm.tokens import Encoder, default_tokenizer

LENGTH, END = 2048, 1


def uint_lists(arrays: list[np.ndarray]) -> pa.Array:
    """Token ids as a list column of 32-bit integers."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))


def id_bytes(arrays: list[np.ndarray]) -> pa.Array:
    """Token ids as a binary column of little-endian 32-bit integers."""
    ends = np.cumsum([0, *map(len, arrays)]) * 4
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype("<u4", copy=False))]
    return pa.Array.from_buffers(pa.binary(), len(arrays), buffers)


def tokenised(
    docs: DataFrame, id_col: str, text_col: str, end: int, tokenizer: str | None = None, as_bytes: bool = False
) -> DataFrame:
    """``id, part, before, n_tokens, tokens``: ids of each row in the order of the task that read it.

    ``part`` is the task's number, ``before`` the ids before the row in this task. ``tokens`` are an array of
    integers or, ``as_bytes``, the bytes of these, which Spark stores as they are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "part", "before", "n_tokens", "tokens"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder(tokenizer or default_tokenizer(), end), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in steps(batch):
                ids = encoder.encode(texts_of(piece.column(1)))
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                parts = pa.array(np.full(len(ids), part, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), parts, pa.array(starts), pa.array(sizes), (id_bytes if as_bytes else uint_lists)(ids)], names
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, part int, before bigint, n_tokens bigint, tokens {'binary' if as_bytes else 'array<int>'}")


def part_starts(table: DataFrame) -> DataFrame:
    """``part, part_start``: ids before each part; one row a part, so it is small."""
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("part_start"))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end: int = END,
    tokenizer: str | None = None,
    ids: bool = True,
) -> DataFrame:
    """One row per piece of a document that lies in one sequence.

    ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``ids``, the piece's
    ``tokens``. Every document is its tokens and then ``end``; null and empty texts are ``end`` only.
    The documents follow each other without a gap, and the row of tokens is cut at every multiple of
    ``length``: all sequences but the last are full.

    First each task writes its documents' ids with the ids before them in the task; sums over the
    tasks' totals then give every document its place. Rows that repeat are packed as often as they
    occur. An empty table gives no row. Only the two named columns are read.
    """
    table = stored(tokenised(docs, id_col, text_col, end, tokenizer, as_bytes=True), "tokens")
    # One row for each task of the first pass, as many as the driver keeps in its own list of tasks.
    placed = table.join(F.broadcast(part_starts(table)), "part")
    rows = placed.select("id", (F.col("part_start") + F.col("before")).alias("at"), "tokens")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins = batch.column(1).to_numpy()
            tokens = batch.column(2).cast(pa.large_binary())
            _, offsets, data = tokens.buffers()
            ends = np.frombuffer(offsets, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] // 4
            flat = np.frombuffer(data, "<u4", count=int(ends[-1]))
            sizes = np.diff(ends).astype(np.int64)
            first, last = begins // length, (begins + sizes - 1) // length
            times = last - first + 1
            row = np.repeat(np.arange(len(begins)), times)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            sequence = first[row] + nth
            start = np.maximum(sequence * length - begins[row], 0)
            stop = np.minimum((sequence + 1) * length - begins[row], sizes[row])
            lo = ends[row] + start
            size = stop - start
            pieces = [flat[a : a + n] for a, n in zip(lo.tolist(), size.tolist(), strict=True)]
            sums = pa.array([zlib.crc32(p) for p in pieces], pa.int64())
            numbers = [start, size, sums, sizes[row], sequence, begins[row] + start - sequence * length]
            columns = [batch.column(0).take(pa.array(row)), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays(columns + [uint_lists(pieces)] * ids, names + ["tokens"] * ids)

    fields = ", ".join(f"{n} bigint" for n in names[1:])
    return rows.mapInArrow(cut, f"id {kind}, {fields}" + ", tokens array<int>" * ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """``sequence_id, tokens, boundaries`` from pieces with ids: each sequence padded to ``length``.

    A sequence whose size is a power of two is left as it is. ``boundaries`` are its pieces' id,
    start, offset and length in order. A sequence has at most ``length`` pieces.
    """
    piece = F.struct("offset", "start", "length", "id", "tokens")
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    ids = F.flatten(F.col("p.tokens"))
    whole = (F.size(ids) == length) | (F.bit_count(F.size(ids)) == 1)
    padded = F.when(whole, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids))))
    marks = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length")))
    return rows.select("sequence_id", padded.alias("tokens"), marks.alias("boundaries"))
