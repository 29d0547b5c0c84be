"""Hard negatives by best-first search in an STR-packed R-tree of integer vectors.

The rows are packed sort-tile-recursively: quantiles of the coordinate of largest variance cut them
into slabs, quantiles within each slab cut by the next coordinate, down to tiles of one task's size.
Within a tile the same packing goes on to leaves. A box of the tree gives an interval for the inner
product with an anchor, coordinate by coordinate. A queue takes the box with the highest upper end
first; boxes outside all score windows or strictly below the k-th score found are not opened.

Anchors search their own tile first. The k-th score found there goes with them to all other tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.common import stored

#: Rows of a tile, of a leaf, and children of an inner node, about; slabs of one coordinate of the tile packing.
TILE_ROWS, LEAF_ROWS, FANOUT, SLABS = 16_384, 256, 16, 8
#: Anchors that travel as one row.
BLOCK = 256
LOW, HIGH = -(2**62), 2**62
#: Products below this are exact in double precision.
EXACT = 2**53

TILE_SCHEMA = "tile bigint, dim int, rows array<bigint>, ids array<bigint>, labels array<string>, values binary"
FOUND_SCHEMA = "anchor_row bigint, asked bigint, row bigint, id bigint, score bigint"


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer vector; clipped to what a long window can hold."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(vector).max(initial=0)) * len(vector)
    if most < EXACT:
        return (rows @ vector).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(row, vector, strict=True)) for row in rows]
    return np.array([min(max(s, LOW), HIGH) for s in exact], np.int64)


def str_order(values: np.ndarray, dims: Sequence[int], leaf: int) -> np.ndarray:
    """Rows in sort-tile-recursive order by the given coordinates, for leaves of ``leaf`` rows."""

    def packed(rows: np.ndarray, k: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        rows = rows[np.argsort(values[rows, dims[k]], kind="stable")]
        if leaves <= 1 or k == len(dims) - 1:
            return [rows]
        slabs = int(np.ceil(leaves ** (1 / (len(dims) - k)) - 1e-9))
        slabs = max(2, slabs)
        size = -(-leaves // slabs) * leaf
        return [part for s in range(0, len(rows), size) for part in packed(rows[s : s + size], k + 1)]

    return np.concatenate(packed(np.arange(len(values)), 0)) if len(values) else np.zeros(0, np.int64)


class Tree:
    """Boxes over the rows of a tile; level 0 has the leaves, the last level one root."""

    def __init__(self, tile: dict):
        self.rows = np.asarray(tile["rows"], np.int64)
        self.ids = np.asarray(tile["ids"], np.int64)
        self.labels = np.asarray(tile["labels"], object)
        self.values = np.frombuffer(tile["values"]).reshape(len(self.rows), -1)
        low = np.minimum.reduceat(self.values, range(0, len(self.rows), LEAF_ROWS))
        high = np.maximum.reduceat(self.values, range(0, len(self.rows), LEAF_ROWS))
        self.levels = [(low, high)]
        while len(low) > 1:
            low = np.minimum.reduceat(low, range(0, len(low), FANOUT))
            high = np.maximum.reduceat(high, range(0, len(high), FANOUT))
            self.levels.append((low, high))

    def intervals(self, level: int, first: int, last: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of the anchor with anything in boxes ``first`` to ``last``."""
        low, high = (side[first:last] for side in self.levels[level])
        return low @ up + high @ down, high @ up + low @ down

    def search(self, vector: np.ndarray, windows: list["Search"]) -> None:
        """Offer every row to the searches, highest boxes first, boxes without a use left out."""
        up, down = np.maximum(vector, 0), np.minimum(vector, 0)
        # Bounds in double precision: a margin of a few roundings keeps them on the safe side.
        queue: list[tuple] = []

        def push(level: int, first: int, last: int) -> None:
            least, most = self.intervals(level, first, last, up, down)
            slack = 1 + 1e-9 * np.maximum(np.abs(least), np.abs(most))
            least, most = (np.clip(x, LOW, HIGH).tolist() for x in (least - slack, most + slack))
            for box, a, b in zip(range(first, last), least, most, strict=True):
                if any(w.wants(a, b) for w in windows):
                    heapq.heappush(queue, (-b, a, level, box))

        top = len(self.levels) - 1
        push(top, 0, 1)
        while queue:
            most, least, level, box = heapq.heappop(queue)
            if not any(w.wants(least, -most) for w in windows):
                continue
            if level:
                first = box * FANOUT
                push(level - 1, first, min(first + FANOUT, len(self.levels[level - 1][0])))
                continue
            part = slice(box * LEAF_ROWS, (box + 1) * LEAF_ROWS)
            scores = products(self.values[part], vector)
            for w in windows:
                w.offer(scores, self.ids[part], self.rows[part], self.labels[part])


class Search:
    """The first ``k`` rows with a score in a window, of the anchor's label or of other labels."""

    def __init__(self, k: int, low: int, high: int, floor: int, label: str, same: bool, own: int):
        self.k, self.low, self.high, self.label, self.same, self.own = k, max(low, floor), high, label, same, own
        self.best = np.zeros((0, 3), np.int64)  # -score, id, row

    def kth(self) -> int:
        return -int(self.best[-1, 0]) if len(self.best) == self.k else self.low

    def wants(self, least: float, most: float) -> bool:
        return least <= self.high and most >= max(self.low, self.kth())

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        fits = (scores >= max(self.low, self.kth())) & (scores <= self.high)
        if not fits.any():
            return
        at = np.flatnonzero(fits)
        at = at[((labels[at] == self.label) == self.same) & (rows[at] != self.own)]
        if len(at):
            new = np.concatenate([self.best, np.column_stack([-scores[at], ids[at], rows[at]])])
            self.best = new[np.lexsort((new[:, 2], new[:, 1], new[:, 0]))[: self.k]]


def usable_rows(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``row, id, label, values``: rows with an id, a label and finite components, as whole numbers."""
    vec, inf = F.col(vector_col).cast("array<double>"), float("inf")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    named = rows.select(F.col(id_col).cast("bigint").alias("id"), label.cast("string").alias("label"), vec.alias("vec"), finite.alias("finite"))
    named = named.where("id IS NOT NULL AND label IS NOT NULL AND finite AND size(vec) > 0")
    whole = F.transform("vec", lambda x: F.floor(F.lit(256.0) * x).cast("double"))
    return named.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("values"))


def widest(rows: DataFrame) -> dict[int, list[int]]:
    """For each length of vectors its coordinates, those of largest variance first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim)).column("values").flatten().to_numpy().reshape(-1, dim)
                with np.errstate(over="ignore"):
                    sums = [[own.shape[0]] * dim, own.sum(axis=0), np.square(own).sum(axis=0)]
                columns = [[dim] * dim, range(dim), *sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["dim", "at", "n", "s", "q"])

    parts = rows.select(F.size("values").alias("dim"), "values").mapInArrow(moments, "dim int, at int, n bigint, s double, q double")
    sums = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    order: dict[int, list] = {}
    for r in sorted(sums, key=lambda r: (r["dim"], -(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2), r["at"])):
        order.setdefault(r["dim"], []).append(r["at"])
    return order


def _slabs(rows: DataFrame, coordinate: Column, tiles: int) -> DataFrame:
    """Cut each ``tile`` with more than ``TILE_ROWS`` rows by quantiles of a coordinate into ``SLABS``."""
    steps = F.array(*[F.lit(k / SLABS) for k in range(1, SLABS)])
    cuts = rows.groupBy("tile").agg(
        F.count(F.lit(1)).alias("n_rows"), F.percentile_approx(coordinate, steps, 1000).alias("cuts")
    )
    # Written: approximate quantiles may differ when they are computed again.
    cuts = stored(cuts.where(F.col("n_rows") > TILE_ROWS).select("tile", "cuts"), "rtree-cuts")
    # The tiles so far, fewer than 8 n / TILE_ROWS rows of a few numbers; broadcast while they are few.
    found = rows.join(F.broadcast(cuts) if tiles <= 100_000 else cuts, "tile", "left")
    slab = F.coalesce(F.size(F.filter("cuts", lambda c: c < coordinate)), F.lit(0))
    return found.withColumn("tile", F.col("tile") * SLABS + slab).drop("cuts")


def tiles_of(rows: DataFrame) -> DataFrame:
    """The stored ``TILE_SCHEMA`` rows of ``usable_rows``: tiles of neighbours in the packing, in leaf order."""
    order = widest(rows)
    packed = None
    for dim, dims in sorted(order.items()):
        some = rows.where(F.size("values") == dim).withColumn("tile", F.pmod("row", F.lit(1)))
        tiles, left = 1, rows.count() / TILE_ROWS
        for at in dims[:6]:
            if tiles >= left:
                break
            some = _slabs(some, F.get("values", F.lit(at)), tiles)
            tiles *= SLABS
        some = some.withColumns({"dim": F.size("values"), "coordinates": F.array(*[F.lit(d) for d in dims])})
        packed = some if packed is None else packed.unionByName(some)
    if packed is None:
        return rows.sparkSession.createDataFrame([], TILE_SCHEMA)
    # Equal coordinates can leave a tile too large: it is dealt into parts of the same box.
    sizes = packed.groupBy("dim", "tile").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("parts"))
    sizes = F.broadcast(sizes) if tiles <= 100_000 else sizes
    packed = packed.join(sizes, ["dim", "tile"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                values = np.array([r["values"] for r in tile["held"]])
                dims = tile["coordinates"][: max(1, int(np.log2(max(2, len(values) / LEAF_ROWS))))]
                at = str_order(values, dims, LEAF_ROWS).tolist()
                held = tile["held"]
                columns = [[tile["tile"]], [tile["dim"]], *[[[held[i][c] for i in at]] for c in ("row", "id", "label")], [values[at].tobytes()]]
                types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in TILE_SCHEMA.split(", ")])

    held = F.collect_list(F.struct("row", "id", "label", "values")).alias("held")
    grouped = packed.groupBy("dim", "tile", "part").agg(held, F.first("coordinates").alias("coordinates"))
    grouped = stored(grouped.withColumn("tile", F.monotonically_increasing_id()), "rtree-groups")
    return stored(grouped.select("tile", "dim", "held", "coordinates").mapInArrow(leaves, TILE_SCHEMA), "rtree-tiles")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row is a tile and a block of anchors; equal tiles follow each other."""
    number, tree = None, None
    for batch in batches:
        tiles = batch.column("tile").to_pylist()
        for at in range(batch.num_rows):
            if tiles[at] != number:
                number = tiles[at]
                tree = Tree({c: batch.column(c)[at].as_py() for c in ("rows", "ids", "labels", "values")})
            out = []
            for ask in batch.column("asks")[at].as_py():
                windows = [Search(ask["k"], w["low"], w["high"], w["floor"], ask["label"], ask["same"], ask["row"]) for w in ask["windows"]]
                tree.search(np.asarray(ask["values"]), windows)
                out += [(ask["row"], w["asked"], int(r), int(i), -int(s)) for w, f in zip(ask["windows"], windows, strict=True) for s, i, r in f.best]
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND_SCHEMA.split(", ")])


def _visit(tiles: DataFrame, asks: DataFrame, blocks: int) -> DataFrame:
    """The searches of ``asks`` (with ``tile``) in their tiles, in so many blocks of anchors."""
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    asked = asks.groupBy("tile", block).agg(F.collect_list(F.struct("row", "label", "values", "k", "same", "windows")).alias("asks"))
    met = asked.join(tiles, "tile").sortWithinPartitions("tile")
    return met.select("tile", "rows", "ids", "labels", "values", "asks").mapInArrow(_search, FOUND_SCHEMA)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "asked").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(tiles: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """``FOUND_SCHEMA`` and ``rank``: the first ``k`` rows of each search of all tiles.

    ``asks``: row, label, values, home, k, same and windows (asked, low, high, floor).
    """
    blocks = max(1, asks.count() // BLOCK)
    home = stored(_visit(tiles, asks.withColumn("tile", F.col("home")), blocks), "rtree-home")
    # The k-th score at home; a search with fewer finds there has none.
    floors = _best(home, k).where(F.col("rank") == k).select("anchor_row", F.struct("asked", "score").alias("one"))
    floors = floors.groupBy("anchor_row").agg(F.map_from_entries(F.collect_list("one")).alias("floors"))
    asks = asks.join(floors, asks["row"] == floors["anchor_row"], "left")
    floor = lambda w: F.greatest(w["floor"], F.try_element_at("floors", w["asked"]))
    asks = asks.withColumn("windows", F.transform("windows", lambda w: w.withField("floor", floor(w))))
    others = tiles.groupBy("dim").agg(F.collect_list("tile").alias("tiles"))
    everywhere = asks.join(F.broadcast(others), F.size("values") == F.col("dim")).withColumn("tile", F.explode("tiles"))
    away = _visit(tiles, everywhere.where(F.col("tile") != F.col("home")).drop("dim", "tiles"), blocks)
    return _best(home.unionByName(away), k)


def mine(
    rows: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(256 * x)``; scores are exact inner products, higher first, ties by the
    smaller id. For each row that ``anchors`` (a condition on ``id``) holds for, its first
    ``n_positives`` other rows of the same label; for each of them the first ``n_negatives`` rows of
    another label with a score between the two percentages of the positive's. Rows with a null id,
    label or vector, an empty vector, or a null or non-finite component take no part; vectors are compared
    with those of their own length. Repeated rows are rows of their own. An anchor without a positive, and a
    positive without a negative, give no rows; nor does an empty table. Only the named columns are read.
    """
    usable = stored(usable_rows(rows, id_col, vector_col, label if label is not None else F.col("label")), "rtree-rows")
    tiles = tiles_of(usable)
    homes = tiles.select(F.col("tile").alias("home"), F.explode("rows").alias("row"))
    chosen = stored(usable.where(anchors).join(homes, "row"), "rtree-anchors")
    window = [F.lit(x).cast("bigint").alias(n) for n, x in (("asked", 0), ("low", LOW), ("high", HIGH), ("floor", LOW))]
    asks = chosen.withColumns({"k": F.lit(n_positives), "same": F.lit(True), "windows": F.array(F.struct(*window))})
    positives = stored(best_rows(tiles, asks, n_positives), "rtree-positives")

    score = F.col("score")
    wide = "CAST(score AS DECIMAL(25, 0))"
    low = F.expr(f"CAST(({wide} * {low_percent} + 99) DIV 100 AS BIGINT)")
    high = F.expr(f"CAST(({wide} * {high_percent}) DIV 100 AS BIGINT)")
    windows = positives.where("score >= 0").select("anchor_row", F.struct(F.col("rank").cast("bigint").alias("asked"), low.alias("low"), high.alias("high"), F.lit(LOW).cast("bigint").alias("floor")).alias("w"))
    windows = windows.groupBy("anchor_row").agg(F.collect_list("w").alias("windows"))
    asks = chosen.join(windows, chosen["row"] == windows["anchor_row"]).drop("anchor_row")
    asks = asks.withColumns({"k": F.lit(n_negatives), "same": F.lit(False)})
    negatives = best_rows(tiles, asks, n_negatives)
    named = positives.join(chosen.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    named = named.select("anchor_row", F.col("rank").cast("bigint").alias("asked"), "anchor_id", F.col("id").alias("positive_id"), score.alias("positive_score"))
    found = negatives.join(named, ["anchor_row", "asked"])
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
