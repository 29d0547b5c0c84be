"""Near-duplicates by similarity of word shingles: SimHash tiles choose the pairs, the shingles decide.

All fingerprints are searched for those within ``NEAR`` bits by ``simhash_dups``. Similar documents may differ in
more bits than such a search can reach; those share a key made of least hashes of their shingles, and the
fingerprints of one key are compared in tiles too. Links of both join documents to neighbourhoods. In
these the shingles themselves are compared, tile by tile, except between documents that are joined already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.llm.common import free_name, numbered_words, steps, stored, texts_of
from sediment.llm.links import components, local_roots
from sediment.llm.simhash_dups import links_of

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Bits by which fingerprints of similar documents may differ. At similarity 0.8 about one in seven differs;
#: four standard deviations more are allowed.
RADIUS = 22
#: Bits within which fingerprints are found whatever their keys.
NEAR = 3
#: Keys of a document, and least hashes that make one: of pairs with similarity 0.8 one in 100,000 has none in common.
KEYS, HASHES = 16, 3
#: Documents of a tile of fingerprints; documents, and shingles in all, of a tile of shingles.
TILE, SHINGLE_TILE, TILE_SHINGLES = 2048, 256, 1 << 17
#: Text that one step of a task handles at once.
STEP = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.random.default_rng(7).integers(1, 2**63, KEYS * HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def shingles_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different shingles of each text, sorted; where each starts and ends; hash of all words in order)."""
    words, numbers, ends = numbered_words([t.lower() if t else t for t in texts])  # bytes.lower changes A-Z only
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[numbers] if words else np.zeros(0, np.uint64)
    sizes = np.diff(ends)
    rolled, power = own.copy(), 1
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(own)) - np.repeat(ends[:-1], sizes)
    left = np.repeat(sizes, sizes) - at
    for k in range(1, SHINGLE_WORDS):
        power, most = power * int(_MULTIPLIER) % (1 << 64), max(0, len(own) - k)
        inside = left[:most] > k  # a text of fewer words is one shingle of those it has
        rolled[:most][inside] += own[k:][inside] * np.uint64(power)
    first = left >= np.minimum(SHINGLE_WORDS, np.repeat(sizes, sizes))
    hashes, text = mixed(rolled[first]), text[first]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    digests = np.array([xxhash.xxh64_intdigest(own[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.uint64)
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts))))), digests


def prints_and_keys(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each text, its keys); a text without a shingle has fingerprint and keys of zero."""
    n = len(ends) - 1
    prints, keys = np.zeros(n, np.uint64), np.zeros((n, KEYS), np.uint64)
    full = np.flatnonzero(np.diff(ends))
    if not len(full):
        return prints, keys
    starts = ends[:-1][full]
    for k in range(64):
        votes = np.add.reduceat(((hashes >> np.uint64(k)) & np.uint64(1)).astype(np.int64), starts)
        prints[full] |= (2 * votes > np.diff(ends)[full]).astype(np.uint64) << np.uint64(k)
    for k in range(KEYS):
        for j in range(HASHES):
            least = np.minimum.reduceat(mixed(hashes * _SALTS[k * HASHES + j]), starts)
            keys[full, k] = keys[full, k] * _MULTIPLIER + least
        keys[full, k] = mixed(keys[full, k] + np.uint64(k))
    return prints, keys


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, digest, fp, n, keys`` of every row; n counts different shingles."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 2, STEP):
                hashes, ends, digests = shingles_of(texts_of(part.column(2)))
                prints, keys = prints_and_keys(hashes, ends)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, KEYS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
                columns = [part.column(0), part.column(1), *[pa.array(x) for x in (digests.view(np.int64), prints.view(np.int64), np.diff(ends))], lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "digest", "fp", "n", "keys"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sketched, f"id {kind}, text_hash bigint, digest bigint, fp bigint, n bigint, keys array<bigint>")


def print_links(texts: DataFrame) -> DataFrame:
    """``a, b``: links between ``digest``s of ``digest, fp`` with fingerprints within ``NEAR`` bits, as forests."""
    firsts = stored(texts.groupBy("fp").agg(F.min("digest").alias("first")), "near-prints")
    same = texts.join(firsts, "fp").where("digest != first").select(F.col("first").alias("a"), F.col("digest").alias("b"))
    found = links_of(firsts.select("fp"), NEAR)
    for side in ("a", "b"):
        found = found.join(firsts.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}")), side)
    return found.select(F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(same)


def neighbour_links(texts: DataFrame) -> DataFrame:
    """``a, b``: links between ``digest``s of ``digest, fp, keys`` with a common key and near fingerprints, as forests.

    Texts of one key are cut into tiles; pairs of tiles are compared, so a key of very many is no one task's work.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides = [(np.array(row[p], np.int64).view(np.uint64), np.array(row[d], np.int64)) for p, d in (("fps", "digests"), ("other_fps", "other_digests"))]
                same = row["part"] == row["q"]
                prints = sides[0][0] if same else np.concatenate([s[0] for s in sides])
                names = sides[0][1] if same else np.concatenate([s[1] for s in sides])
                i, j = near_rows(sides[0][0], sides[1][0], same)
                root = local_roots(i, j, len(prints))
                some = np.flatnonzero(root != np.arange(len(prints)))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]])], ["a", "b"])

    keyed = texts.select("digest", "fp", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    sizes = sizes.select("key", F.ceil(F.col("held") / TILE).cast("int").alias("parts"))
    keyed = stored(keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")), "near-keys")
    tiles = keyed.groupBy("key", "part").agg(F.first("parts").alias("parts"), F.collect_list("fp").alias("fps"), F.collect_list("digest").alias("digests"))
    tiles = stored(tiles, "near-tiles")
    sent = tiles.select("key", F.col("part").alias("q"), F.col("fps").alias("other_fps"), F.col("digests").alias("other_digests"), F.explode(F.sequence(F.lit(0), "part")).alias("part"))
    return tiles.drop("parts").join(sent, ["key", "part"]).mapInArrow(compare, "a bigint, b bigint")


def near_rows(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows of two tiles within the radius, thinned band by band; rows of ``b`` count after those of ``a``."""
    shift, n = (0, len(a)) if same else (len(a), len(a) + len(b))
    kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= RADIUS)
        i, j = i + at, j + shift
        if len(i) > n:
            root = local_roots(i, j, n)
            i = np.flatnonzero(root != np.arange(n))
            j = root[i]
        kept[0].append(i)
        kept[1].append(j)
    return np.concatenate(kept[0]), np.concatenate(kept[1])


def similar_links(docs: DataFrame, hoods: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``a, b``: links of texts with a similarity of ``SIMILARITY`` or more, as forests, within neighbourhoods.

    ``hoods``: id and text_hash (of one row of each different text), digest, hood, fp, n.
    """

    def with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for part in steps(batch, text, STEP):
                hashes, ends, _ = shingles_of(texts_of(part.column(text)))
                lists = pa.LargeListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))
                columns = [part.column(c) for c in ("digest", "hood", "fp")]
                yield pa.RecordBatch.from_arrays([*columns, lists.cast(pa.list_(pa.int64()))], ["digest", "hood", "fp", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("part")[row] == batch.column("q")[row]
                found = joined_pairs(*(tile_texts(batch.column(c), row) for c in ("held", "other")), same)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    name = free_name(docs, "key")
    texts = docs.select(F.col(id_col).alias(name), F.col(text_col).cast("string").alias("text"))
    same = texts[name].eqNullSafe(hoods["id"]) & (F.xxhash64(texts["text"]) == hoods["text_hash"])
    rows = texts.join(hoods.hint("merge"), same)
    rows = rows.select("digest", "hood", "fp", "text").dropDuplicates(["digest"])
    rows = rows.mapInArrow(with_shingles, "digest bigint, hood bigint, fp bigint, shingles array<bigint>")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / SHINGLE_TILE, F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = hoods.groupBy("hood").agg(F.greatest(F.lit(1), parts).alias("parts"))
    rows = rows.join(sizes, "hood").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    held = F.collect_list(F.struct("digest", "fp", "shingles")).alias("held")
    tiles = stored(rows.groupBy("hood", "part").agg(held), "near-shingles")
    sent = tiles.select("hood", F.col("part").alias("q"), F.col("held").alias("other"), F.explode(F.sequence(F.lit(0), "part")).alias("part"))
    return tiles.join(sent, ["hood", "part"]).select("held", "other", "part", "q").mapInArrow(compare, "a bigint, b bigint")


def tile_texts(column: pa.ListArray, row: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(digests, fingerprints, sorted shingles) of the texts of a tile, as they lie in the batch."""
    texts = column[row].values
    lists = texts.field("shingles")
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    sets = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return texts.field("digest").to_numpy(), texts.field("fp").to_numpy().view(np.uint64), sets


def joined_pairs(held, other, same: bool) -> list[tuple[int, int]]:
    """Links (digest, digest) between the texts of two tiles that are similar; joined texts are not compared again."""
    n = len(held[0])
    digests, prints = held[:2] if same else (np.concatenate([held[k], other[k]]) for k in range(2))
    sets = held[2] if same else held[2] + other[2]
    sizes, root, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(n):
        others = np.arange(i + 1 if same else n, len(sets))
        near = np.bitwise_count(prints[others] ^ prints[i]) <= RADIUS
        near &= np.minimum(sizes[others], sizes[i]) >= SIMILARITY * np.maximum(sizes[others], sizes[i]) - 1e-9
        for j in others[near].tolist():
            if root[i] == root[j]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= SIMILARITY * (sizes[i] + sizes[j] - common) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                out.append((int(digests[i]), int(digests[j])))
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, component_id`` for every row: the smallest id of the row's group of near-duplicates.

    Texts are cut into words at white space, A-Z in lower case; their sets of five-word shingles (one of
    all words, if there are fewer) decide: rows link at a similarity of 0.8 or more, and rows that reach
    each other by links are a group. Texts without a word are equal to each other. Null ids name no group.
    Repeated rows each have a result; an empty table has none.
    """
    rows = stored(sketches(docs, id_col, text_col), "near-sketches")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("one")  # the smallest id, null if there is none
    texts = rows.groupBy("digest").agg(one, *[F.any_value(c).alias(c) for c in ("fp", "n", "keys")])
    texts = stored(texts.select("digest", "one.id", "one.text_hash", "fp", "n", "keys"), "near-texts")
    near = print_links(texts.select("digest", "fp")).unionByName(neighbour_links(texts.select("digest", "fp", "keys")))
    hoods = components(near)
    hoods = stored(hoods.select(F.col("node").alias("digest"), F.col("root").alias("hood")).join(texts.drop("keys"), "digest"), "near-hoods")
    found = components(similar_links(docs, hoods, id_col, text_col))
    found = found.select(F.col("node").alias("digest"), "root").join(texts.select("digest", "id"), "digest")
    lowest = found.groupBy("root").agg(F.min("id").alias("component"))
    named = texts.select("digest", F.col("id").alias("lowest")).join(found.join(lowest, "root").select("digest", "component"), "digest", "left")
    named = stored(named.select("digest", F.coalesce("component", "lowest").alias("component_id")), "near-groups")
    return rows.select("id", "digest").join(named, "digest").select("id", "component_id")


def _orderable(column: str, kind: T.DataType) -> Column:
    plain = isinstance(kind, (T.AtomicType, T.NullType)) and not isinstance(kind, T.VariantType)
    return F.col(f"`{column}`") if plain else F.to_json(F.struct(F.col(f"`{column}`")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; all columns stay.

    Of several rows with this id, the first in the order of all columns stays, whatever the order they come
    in. Rows with a null id are in no group and all stay. An empty table gives no rows.
    """
    found = groups(docs, id_col, text_col)
    keep = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("keep")).distinct()
    named = docs.join(keep, docs[id_col] == keep["keep"], "left_semi")
    rank = free_name(docs, "rank")
    order = [_orderable(f.name, f.dataType) for f in docs.schema.fields]
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), *order)
    named = named.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return named.unionByName(docs.where(docs[id_col].isNull()))
