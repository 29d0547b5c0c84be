"""Near-duplicates by 64-bit SimHash and exact comparison of tiles of fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import steps, stored, texts_of
from sediment.llm.links import components, local_roots

#: The fingerprint is seen as so many blocks; a tile's fingerprints have equal counts of bits in each.
BLOCKS, BLOCK_BITS = 4, 16
BASE = BLOCK_BITS + 1
CELLS = BASE**BLOCKS
#: Fingerprints of a tile, about; a cell with more has several tiles.
TILE = 2048
#: Rows of a tile that are compared at once with all of the other tile.
BAND = 256


def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included; 0 if there is no word."""
    words = text.lower().split() if text else []  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle_words, len(words)) - 1
    first, last = starts[: len(words) - span].tolist(), ends[span:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), 1 << 16):
        pairs = zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)
        hashes = np.array([digest(joined[s:e], seed) for s, e in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp``: the fingerprint of each row as a signed long. Null text: 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                found = np.array([fingerprint(t) for t in texts_of(part.column(1))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(hashed, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _cell(fp: Column) -> Column:
    """The counts of bits of the blocks as one number below ``CELLS``."""
    counts = [
        F.bit_count(F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
        for b in range(BLOCKS)
    ]
    return sum((c * BASE**b for b, c in enumerate(counts)), F.lit(0)).cast("int")


def near_offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of block counts that fingerprints within the radius can have, one of each +-pair."""
    reach = range(-radius, radius + 1)
    every = (d for d in itertools.product(reach, repeat=BLOCKS) if sum(map(abs, d)) <= radius)
    return sorted(d for d in every if d >= (0,) * BLOCKS)


def tiles_of(fps: DataFrame) -> DataFrame:
    """``cell, part, fps`` from distinct ``fp``: tiles of about ``TILE`` fingerprints at most."""
    keyed = fps.select("fp", _cell(F.col("fp")).alias("cell"))
    sizes = keyed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # At most CELLS rows of two ints whatever the input, so this side may be broadcast.
    keyed = keyed.join(F.broadcast(sizes), "cell").select("cell", part.alias("part"), "fp")
    return keyed.groupBy("cell", "part").agg(F.collect_list("fp").alias("fps"))


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """``a, b, same``: the pairs of tiles whose counts of bits differ by no more than the radius.

    Two fingerprints differ in at least as many bits as the counts of their blocks differ in sum, so
    all other pairs of tiles are skipped. Each tile is sent to the cells that its counts can reach
    and that have tiles; the pairs are found by an equal cell and part.
    """
    digit = [F.pmod(F.floor(F.col("cell") / BASE**b), F.lit(BASE)).cast("int") for b in range(BLOCKS)]
    offsets = near_offsets(radius)
    moves = [
        F.when(
            # no block may leave its range of counts
            F.lit(True) if not any(d) else _all([(digit[b] + d[b]).between(0, BLOCK_BITS) for b in range(BLOCKS)]),
            F.col("cell") + sum(d[b] * BASE**b for b in range(BLOCKS)),
        )
        for d in offsets
    ]
    sent = tiles.select(
        "fps", "part", F.col("cell").alias("from"), F.explode(F.array_compact(F.array(*moves))).alias("cell")
    )
    # At most CELLS rows. A tile goes to each part of the other cell, so that no cell is one task's work.
    there = F.broadcast(tiles.groupBy("cell").agg(F.max("part").alias("most")))
    own = F.col("cell") == F.col("from")
    parts = F.explode(F.sequence(F.lit(0), F.when(own, F.col("part")).otherwise(F.col("most"))))
    sent = sent.join(there, "cell").select("cell", "from", F.col("part").alias("q"), F.col("fps").alias("b"), parts.alias("part"))
    at = tiles.select("cell", "part", F.col("fps").alias("a"))
    pairs = at.join(sent, ["cell", "part"])
    return pairs.select("a", "b", (own & (F.col("part") == F.col("q"))).alias("same"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def linked(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, thinned to a forest with the same components: (node, root)."""
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    kept_i, kept_j = [], []
    for at in range(0, len(a), BAND):
        close = np.bitwise_count(a[at : at + BAND, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(close)
        i, j = i + at, j + shift
        if len(i) > len(nodes):  # more links than a forest can have
            root = local_roots(i, j, len(nodes))
            i = np.flatnonzero(root != np.arange(len(nodes)))
            j = root[i]
        kept_i.append(i)
        kept_j.append(j)
    root = local_roots(np.concatenate(kept_i), np.concatenate(kept_j), len(nodes))
    i = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[i], nodes[root[i]]


def links_of(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``a, b``: enough links between distinct fingerprints to connect all that are linked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, same = (batch.column(k) for k in range(3))
            for row in range(batch.num_rows):
                x, y = (np.asarray(c[row].values).view(np.uint64) for c in (a, b))
                i, j = linked(x, y, same[row].as_py(), radius)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(i.view(np.int64)), pa.array(j.view(np.int64))], ["a", "b"])

    return tile_pairs(stored(tiles_of(fps), "tiles"), radius).mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """``id, fingerprint, component_id`` for every row of ``docs``.

    Rows link if their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the
    smallest id reachable. Null and empty texts have fingerprint zero and link like any other. A
    null id gets its component's smallest id, null if all its ids are null. Repeated rows each
    have a result row. An empty table gives none. Only the two named columns are read.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("id").alias("lowest"))
    found = components(links_of(rows.select("fp").distinct(), radius))
    found = found.select(F.col("node").alias("fp"), "root").join(groups, "fp")
    lowest = found.groupBy("root").agg(F.min("lowest").alias("component"))
    found = found.join(lowest, "root").select("fp", "component")
    named = groups.join(found, "fp", "left").select("fp", F.coalesce("component", "lowest").alias("component_id"))
    # Written, so that the join below deals both sides out anew and Spark can split a fingerprint of many rows.
    named = stored(named, "components")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(named, "fp").select("id", hexed, "component_id")
