"""Near-duplicates of vectors: rotated binary codes decide which pairs need their exact cosine.

Equal vectors are one class. Each class is turned by a random rotation; its code holds the signs of
the rotated coordinates and its factor is the cosine ``c`` between vector and code. For a vector ``q``
with cosine ``t`` to the code, ``t / c`` is an unbiased estimate of the cosine of the two vectors. Two
bounds say which pairs cannot reach the threshold: a certain one (the angle to the code and the code's
own angle differ by no more than the angle of the pair) and one that holds with the confidence of
``sigmas`` standard deviations of the estimate. All other pairs are computed exactly.

Classes of one label are cut into tiles. Tiles first exchange codes and factors only, about a thirtieth
of the vectors; the pairs of tiles in which some pair is left exchange the vectors. Pairs of tiles that
lie too far apart as balls are not met at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import stored
from sediment.llm.links import components, local_roots

COSINE = 0.93
#: Standard deviations of the estimate's confidence bound: a pair is lost with probability 2e-9 at most.
SIGMAS = 6.0
#: Classes of a tile at most, and rows of a tile compared at once with all of another.
TILE, BAND = 1024, 256
SEED = 20

TILE_SCHEMA = (
    "label string, dim int, cids array<bigint>, weights array<bigint>, vectors binary, codes binary, "
    "factors array<float>, centre array<double>, reach double"
)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, factors) of unit vectors; the factor is the cosine of vector and code."""
    turned = units @ turn
    factors = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned >= 0, axis=1), factors.astype(np.float32)


def least_code_cosine(factors: np.ndarray, dim: int, cosine: float, sigmas: float) -> np.ndarray:
    """For each code the cosine that a vector has with it at least, if the pair reaches ``cosine``."""
    c = np.minimum(factors.astype(np.float64), 1.0)
    certain = np.cos(np.minimum(np.arccos(c) + np.arccos(cosine), np.pi))
    confident = c * cosine - np.sqrt(1 - c * c) * sigmas / np.sqrt(max(dim - 1, 1))
    return np.maximum(certain, confident) - 1e-6


def signs(codes: bytes, n: int, dim: int) -> np.ndarray:
    """Packed codes as unit vectors of +-1 / sqrt(dim)."""
    bits = np.unpackbits(np.frombuffer(codes, np.uint8).reshape(n, -1), axis=1, count=dim)
    return (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def near_codes(turned: np.ndarray, code_units: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bands of (row of ``turned``, row of the codes) that the bounds do not rule out."""
    for at in range(0, len(turned), BAND):
        i, j = np.nonzero(turned[at : at + BAND] @ code_units.T >= least)
        yield i + at, j


def _valid(label: Column, vector: Column) -> Column:
    inf = float("inf")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of label, size and code as tiles of one label and size."""
    held, kind, count = [], None, 0

    def tile() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        vectors = np.frombuffer(b"".join(rows["vector"].to_pylist())).reshape(count, -1)
        units = unit(vectors)
        mean = units.mean(axis=0)
        centre = mean / max(np.linalg.norm(mean), 1e-300)
        reach = float(np.arccos(np.clip((units @ centre).min(), -1, 1)))
        columns = [
            [kind[0]], [kind[1]], [rows["cid"].to_pylist()], [rows["weight"].to_pylist()], [vectors.tobytes()],
            [b"".join(rows["code"].to_pylist())], [rows["factor"].to_pylist()], [centre.tolist()], [reach],
        ]
        types = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(),
                 pa.list_(pa.float32()), pa.list_(pa.float64()), pa.float64()]
        names = [f.split()[0] for f in TILE_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
        start = 0
        for row in range(batch.num_rows + 1):
            new = (labels[row], dims[row]) if row < batch.num_rows else kind
            if new != kind or count + row - start == TILE:
                if row > start:
                    held.append(batch.slice(start, row - start))
                    count += row - start
                if count:
                    yield tile()
                held, count, start, kind = [], 0, row, new
        if batch.num_rows > start:
            held.append(batch.slice(start))
            count += batch.num_rows - start
    if count:
        yield tile()


def tiles_of(classes: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """Tiles of ``cid, label, vec, weight``; classes with like codes lie together."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                vectors = own.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                codes, factors = encode(unit(vectors), rotation(dim))
                columns = [own.column(k) for k in ("cid", "label", "dim", "weight")]
                columns += [pa.array([v.tobytes() for v in vectors]), pa.array([c.tobytes() for c in codes]), pa.array(factors)]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "label", "dim", "weight", "vector", "code", "factor"])

    rows = classes.select("cid", "label", F.size("vec").alias("dim"), "weight", "vec")
    rows = rows.mapInArrow(coded, "cid bigint, label string, dim int, weight bigint, vector binary, code binary, factor float")
    order = ["label", "dim", "code", "cid"]
    tiles = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, TILE_SCHEMA)
    return stored(tiles.withColumn("tile", F.monotonically_increasing_id()), "vector-tiles")


def tile_pairs(tiles: DataFrame, cosine: float) -> DataFrame:
    """``a, b``: pairs of tiles of a label, each once, that may hold a pair of near vectors."""
    ball = tiles.select("tile", "label", "dim", "centre", "reach")
    left = ball.select("label", "dim", F.col("tile").alias("a"), F.col("centre").alias("x"), F.col("reach").alias("r"))
    right = ball.select("label", "dim", F.col("tile").alias("b"), F.col("centre").alias("y"), F.col("reach").alias("s"))
    products = F.zip_with("x", "y", lambda x, y: x * y)
    apart = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.aggregate(products, F.lit(0.0), lambda n, p: n + p))))
    near = apart <= F.col("r") + F.col("s") + float(np.arccos(cosine)) + 1e-6
    return left.join(right, ["label", "dim"]).where((F.col("a") <= F.col("b")) & near).select("a", "b")


def _open_pairs(pairs: DataFrame, tiles: DataFrame, cosine: float, sigmas: float) -> DataFrame:
    """The pairs of different tiles in which the codes leave a pair of vectors, and each tile with itself."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                turned = (unit(np.frombuffer(row["vectors"]).reshape(-1, dim)) @ rotation(dim)).astype(np.float32)
                factors = np.asarray(row["factors"], np.float32)
                least = least_code_cosine(factors, dim, cosine, sigmas).astype(np.float32)
                if any(len(i) for i, _ in near_codes(turned, signs(row["codes"], len(factors), dim), least)):
                    yield pa.RecordBatch.from_arrays([pa.array([row["a"]]), pa.array([row["b"]])], ["a", "b"])

    codes = tiles.select(F.col("tile").alias("b"), "codes", "factors")
    vectors = tiles.select(F.col("tile").alias("a"), "dim", "vectors")
    met = pairs.where("a < b").join(codes, "b").join(vectors, "a")
    met = met.select("a", "b", "dim", "vectors", "codes", "factors").mapInArrow(left, "a bigint, b bigint")
    return met.unionByName(pairs.where("a = b"))


def exact_links(pair: dict, cosine: float, sigmas: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, root, links to rows of other classes) for the classes of a pair of tiles that have a link."""
    dim, same = pair["dim"], pair["a"] == pair["b"]
    sides = [unit(np.frombuffer(pair[k]).reshape(-1, dim)) for k in ("vectors", "other_vectors")]
    weights = [np.asarray(pair[k], np.int64) for k in ("weights", "other_weights")]
    ids = [np.asarray(pair[k], np.int64) for k in ("cids", "other_cids")]
    factors = np.asarray(pair["other_factors"], np.float32)
    least = least_code_cosine(factors, dim, cosine, sigmas).astype(np.float32)
    turned = (sides[0] @ rotation(dim)).astype(np.float32)
    codes = signs(pair["other_codes"], len(factors), dim)
    shift = 0 if same else len(ids[0])
    nodes = ids[0] if same else np.concatenate(ids)
    counts, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for i, j in near_codes(turned, codes, least):
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):  # the vectors of so many pairs at a time
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            close = np.einsum("ij,ij->i", sides[0][x], sides[1][y]) >= cosine
            x, y = x[close], y[close]
            np.add.at(counts, x, weights[1][y])
            np.add.at(counts, y + shift, weights[0][x])
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            root = local_roots(np.concatenate([tied, x]), np.concatenate([root[tied], y + shift]), len(nodes))
    some = np.flatnonzero(counts)
    return nodes[some], nodes[root[some]], counts[some]


def class_links(tiles: DataFrame, cosine: float = COSINE, sigmas: float = SIGMAS) -> DataFrame:
    """``cid, root, n``: for each pair of tiles the links of its classes, thinned to a forest, and their number."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = exact_links(batch.slice(row, 1).to_pylist()[0], cosine, sigmas)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["cid", "root", "n"])

    pairs = stored(_open_pairs(tile_pairs(tiles, cosine), tiles, cosine, sigmas), "vector-tile-pairs")
    first = tiles.select(F.col("tile").alias("a"), "dim", "cids", "weights", "vectors")
    second = tiles.select(
        F.col("tile").alias("b"), *[F.col(c).alias(f"other_{c}") for c in ("cids", "weights", "vectors", "codes", "factors")]
    )
    met = pairs.join(first, "a").join(second, "b")
    return stored(met.mapInArrow(compare, "cid bigint, root bigint, n bigint"), "vector-links")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    sigmas: float = SIGMAS,
) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows link if their labels are equal and not null, their vectors have the same length and the
    cosine of these, in double precision, is ``cosine`` (above 0) or more. ``n_links`` counts the other
    rows that a row links with, ``component_id`` is the smallest id reachable, itself included, and
    ``kept`` says that it is the row's own. A null, empty or zero vector, and one with a null or
    non-finite component, links with nothing. Rows with equal vectors and label link with each other
    and are compared once; repeated ids are rows of their own. A null id counts as a row but names no
    component and is not kept. An empty table gives no rows. Only the named columns are read.
    """
    vec = F.col(vector_col).cast("array<double>")
    label = F.col(label_col).cast("string")
    usable = _valid(label, vec)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.when(usable, label).alias("label"), F.when(usable, vec).alias("vec")
    )
    lowest = F.min("id").alias("lowest")
    classes = rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(lowest, F.count(F.lit(1)).alias("weight"))
    # Written, so that the join below deals rows out anew and Spark can split a vector of many rows.
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    links = class_links(tiles_of(classes, sigmas), cosine, sigmas)

    counts = links.groupBy("cid").agg(F.sum("n").alias("others"))
    roots = components(links.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    roots = roots.select(F.col("node").alias("cid"), "root")
    least = roots.join(classes.select("cid", "lowest"), "cid").groupBy("root").agg(F.min("lowest").alias("component"))
    named = roots.join(least, "root").select("cid", "component")
    named = classes.select("cid", "label", "vec", "lowest", "weight").join(counts, "cid", "left").join(named, "cid", "left")
    n_links = (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("linked")
    named = stored(named.select("label", "vec", n_links, F.coalesce("component", "lowest").alias("component")), "vector-components")
    found = rows.where("vec IS NOT NULL").join(named, ["label", "vec"]).select("id", "linked", "component")
    alone = rows.where("vec IS NULL").select("id", F.lit(0).cast("bigint").alias("linked"), F.col("id").alias("component"))
    own = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.unionByName(alone).select("id", F.col("linked").alias("n_links"), F.col("component").alias("component_id"), own.alias("kept"))
