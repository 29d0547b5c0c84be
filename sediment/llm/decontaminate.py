"""Documents that hold a passage of a benchmark: SimHash windows of an item's size, found by Hamming blocks.

Everything is DataFrame functions. Windows of an item's size are placed at every start from which enough
shingles of an item, in any order, lie within its length. Their fingerprints are cut into more blocks than
bits may differ, so a window and an item within the radius agree in one block at least and meet in an
equi-join on it; the weighted similarity of their shingles then decides. Windows with enough shingles of
an item whose fingerprint is beyond the radius go to the same decision directly, so none is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.bitmap import bitmap_of, bound
from sediment.llm.common import ascii_lower, stored, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints may differ that meet by their blocks; one block more than that.
RADIUS = 11
EDGES = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
#: Benchmark shingles up to which they are sent to every task.
BROADCAST_ROWS = 500_000

FOUND_SCHEMA = "start bigint, n_words bigint, hamming int, similarity double, route string"


def shingle_hashes(words: Column, size: int) -> Column:
    """Hash of every run of ``size`` words; null if there are fewer words."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (size - 1))
        return F.when(F.size(w) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size))))

    return bound(words, runs)


def fingerprint(words: Column) -> Column:
    """64 majority bits over the hashes of the words, each as often as it occurs."""
    long = lambda x: F.lit(x).cast("bigint")
    mask = 0x0001000100010001

    def lane_votes(hashes: Column, k: int) -> Column:
        """Votes for the bits k, k + 16, k + 32 and k + 48, in four lanes of 16 bits."""
        ones = F.transform(hashes, lambda h: F.shiftrightunsigned(h, k).bitwiseAND(long(mask)))
        return F.aggregate(ones, long(0), lambda n, one: n + one)

    def few(hashes: Column) -> Column:
        def bit(k: int, lane: int, votes: Column) -> Column:
            count = F.shiftrightunsigned(votes, 16 * lane).bitwiseAND(long(0xFFFF))
            value = 1 << (k + 16 * lane)
            return F.when(count * 2 > F.size(hashes), long(value - (1 << 64) if value >> 63 else value)).otherwise(long(0))

        def row(votes: Column) -> Column:
            out = long(0)
            for k in range(16):
                for lane in range(4):
                    out = out.bitwiseOR(bit(k, lane, F.get(votes, F.lit(k))))
            return out

        return bound(F.array(*[lane_votes(hashes, k) for k in range(16)]), row)

    def many(hashes: Column) -> Column:
        def bit(b: Column) -> Column:
            votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int") * 2 - 1)
            return F.when(votes > 0, F.call_function("shiftleft", long(1), b)).otherwise(long(0))

        all_bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
        return F.aggregate(all_bits, long(0), lambda a, b: a.bitwiseOR(b))

    # A lane counts to 65,535.
    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < 65_536, few(h)).otherwise(many(h)))


def blocks(fp: Column) -> Column:
    """``block, bits`` of a fingerprint: two that differ in ``RADIUS`` bits or fewer share one."""
    parts = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))
    ]
    return F.array(*parts)


def similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over sum of the larger counts of two lists of shingle hashes."""

    def both(x: Column) -> Column:
        def least(n: Column, h: Column) -> Column:
            count = [F.size(F.filter(x[side], lambda y: y == h)) for side in ("a", "b")]
            return n + F.least(*count)

        common = F.array_intersect(x["a"], x["b"])
        repeats = F.size(F.array_distinct(x["a"])) < F.size(x["a"])
        shared = F.when(repeats, F.aggregate(common, F.lit(0), least)).otherwise(F.size(common))
        return shared / (F.size(x["a"]) + F.size(x["b"]) - shared)

    return bound(F.struct(a.alias("a"), b.alias("b")), both)


def item_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``key, item, n, size, shingles, fp`` of every item with a word; size is that of its shingles."""
    words = words_of(ascii_lower(F.col(text_col).cast("string")))
    items = benchmark.select(F.col(item_col).alias("item"), words.alias("w")).where(F.size("w") > 0)
    items = items.select("item", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"))
    whole = F.array(F.xxhash64("w"))
    shingles = F.when(F.size("w") >= SHINGLE, shingle_hashes(F.col("w"), SHINGLE)).otherwise(whole)
    key = F.monotonically_increasing_id().alias("key")
    return items.select(key, "item", "n", "size", shingles.alias("shingles"), fingerprint(F.col("w")).alias("fp"))


def needed(shingles: Column, item_shingles: Column, similar: float) -> Column:
    """Shingles that lists of these lengths share at least if they are similar."""
    return F.greatest(F.lit(1), F.ceil((shingles + item_shingles) * (similar / (1 + similar)) - 1e-9)).cast("int")


def window_starts(found: Column, least: Column, n_shingles: Column, last: Column) -> Column:
    """Starts up to ``last`` of windows that hold ``least`` of the sorted positions, in order of the positions."""

    def starts(x: Column) -> Column:
        runs = F.sequence(F.lit(0), F.size(x["found"]) - x["least"])

        def of_run(j: Column) -> Column:
            low = F.greatest(F.lit(0), F.get(x["found"], j + x["least"] - 1) - x["n"] + 1)
            high = F.least(F.get(x["found"], j), x["last"])
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.when(F.size(x["found"]) >= x["least"], F.array_distinct(F.flatten(F.transform(runs, of_run))))

    return bound(F.struct(found.alias("found"), least.alias("least"), n_shingles.alias("n"), last.alias("last")), starts)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    similar: float = SIMILARITY,
) -> DataFrame:
    """``id, text_hash, item, start, n_words, hamming, similarity``: the best window per row and item.

    Words are cut at white space and compared with A-Z in lower case. A window has as many words as
    the item (or is the whole text if that is shorter) and ``start`` counts words from 0. It is
    reported if the five-word shingles of both, repeats counted, have a weighted similarity of
    ``similar`` or more; ``hamming`` counts the bits by which their word fingerprints differ, and
    ``route`` says whether they met by ``blocks`` or, further apart, by shared ``shingles``. Items with fewer than five words are one shingle. Null and empty texts and items have no windows; a null id is
    kept as it is; ``text_hash`` tells rows with equal ids apart; repeated rows give one result. No
    items or no documents: no rows. Only the named columns are read.
    """
    names = [f.split()[0] for f in FOUND_SCHEMA.split(", ")]
    items = stored(item_table(benchmark, item_col, item_text), "benchmark-items")
    sizes = items.groupBy("size").agg(F.min("n").alias("low"), F.max("n").alias("high")).orderBy("size").collect()
    if not sizes:
        empty = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("bigint").alias("text_hash")).where("false")
        kind = benchmark.schema[item_col].dataType
        nulls = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in FOUND_SCHEMA.split(", "))]
        return empty.select("*", F.lit(None).cast(kind).alias("item"), *nulls)
    windows = _windows(docs, items, sizes, id_col, text_col, similar)
    found = _checked(windows, _met_by_blocks(windows, items), items, similar)
    best = F.min_by(F.struct(*names), F.struct(-F.col("similarity"), "start"))
    return found.groupBy("id", "text_hash", "item").agg(best.alias("best")).select("id", "text_hash", "item", "best.*")


def _windows(docs: DataFrame, items: DataFrame, sizes: list, id_col: str, text_col: str, similar: float) -> DataFrame:
    """``window, id, text_hash, start, n, size, shingles, fp, key``: windows with enough shingles of item ``key``.

    One pass over the texts for all sizes of shingles; a window is cut out of its text before it meets
    anything, so a text's words travel once for each item that it shares shingles with.
    """
    places = items.select("key", "n", "size", F.explode("shingles").alias("h")).distinct()
    keys = bitmap_of(places.select("h").distinct(), "h")
    text = F.col(text_col).cast("string")
    words = words_of(ascii_lower(text))

    def seeds(w: Column, size: int, low: int, high: int) -> Column:
        """The shingles of a text that may be an item's, if enough of them lie within the length of an item."""
        # A text that is shorter than the item shares less than a whole window, but no less than this.
        least = max(1, math.ceil((low - size + 1) * similar - 1e-9))

        def passed(hashes: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: keys.may_hold(F.get(hashes, i)))
            return F.transform(at, lambda i: F.struct(F.lit(size).alias("size"), i.alias("p"), F.get(hashes, i).alias("h")))

        def crowded(found: Column) -> Column:
            runs = F.sequence(F.lit(0), F.size(found) - least)
            near = F.exists(runs, lambda j: F.get(found, j + (least - 1))["p"] - F.get(found, j)["p"] < high)
            return F.when(F.size(found) >= least, F.when(near, found))

        none = F.array().cast("array<struct<size: int, p: int, h: bigint>>")
        return F.coalesce(bound(bound(shingle_hashes(w, size), passed), crowded), none)

    # All from the text in one expression: the filter is moved below this projection, and a column of
    # words would be computed anew for every word there.
    marked = bound(words, lambda w: F.concat(*[seeds(w, r["size"], r["low"], r["high"]) for r in sizes]))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), words.alias("w"), marked.alias("seeds"))
    rows = rows.where(F.size("seeds") > 0)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "benchmark-suspects")

    n_places = places.count()
    asked = rows.select("row", F.size("w").alias("total"), F.explode("seeds").alias("s")).select("row", "total", "s.*")
    joined = asked.join(F.broadcast(places) if n_places <= BROADCAST_ROWS else places, ["size", "h"])
    held = joined.groupBy("row", "key", "total", "n", "size").agg(F.array_sort(F.collect_list("p")).alias("found"))
    in_item = F.col("n") - (F.col("size") - 1)
    in_window = F.least(F.col("n"), F.col("total")) - (F.col("size") - 1)
    last = F.greatest(F.lit(0), F.col("total") - F.col("n"))
    starts = window_starts(F.col("found"), needed(in_window, in_item, similar), in_window, last)
    placed = held.select("row", "key", "n", "size", starts.alias("starts")).where(F.size("starts") > 0)
    cut = placed.join(rows.select("row", "id", "text_hash", "w"), "row")
    cut = cut.select("id", "text_hash", "key", "n", "size", F.explode("starts").alias("start"), F.col("w"))
    cut = cut.withColumn("words", F.slice("w", F.col("start") + 1, F.col("n"))).drop("w")
    shingles = F.lit(None).cast("array<bigint>")
    for r in sizes:
        shingles = F.when(F.col("size") == r["size"], shingle_hashes(F.col("words"), r["size"])).otherwise(shingles)
    windows = cut.select("id", "text_hash", "key", "n", "size", "start", shingles.alias("shingles"), fingerprint(F.col("words")).alias("fp"))
    return stored(windows.withColumn("window", F.monotonically_increasing_id()), "benchmark-windows")


def _met_by_blocks(windows: DataFrame, items: DataFrame) -> DataFrame:
    """``window, key`` of every window and item of its size whose fingerprints differ in ``RADIUS`` bits or fewer."""
    once = windows.groupBy("id", "text_hash", "start", "n", "size").agg(F.min_by("fp", "window").alias("fp"), F.min("window").alias("window"))
    sent = once.select("window", "n", "size", "fp", F.inline(blocks(F.col("fp"))))
    there = items.select("key", "n", "size", F.col("fp").alias("item_fp"), F.inline(blocks(F.col("fp"))))
    met = sent.join(there, ["n", "size", "block", "bits"])
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    return met.where(near).select("window", "key").distinct()


def _checked(windows: DataFrame, met: DataFrame, items: DataFrame, similar: float) -> DataFrame:
    """The windows that are similar to an item: met by blocks, or by shingles beyond the radius."""
    sides = items.select("key", "item", F.col("fp").alias("item_fp"), F.col("shingles").alias("item_shingles"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int").alias("hamming")
    columns = ["id", "text_hash", "item", "start", "n", "shingles", "item_shingles", apart]
    own = windows.select("window", "id", "text_hash", "start", "n", "shingles", "fp")
    by_blocks = met.join(own, "window").join(sides, "key").select(*columns, F.lit("blocks").alias("route"))
    by_shingles = windows.join(sides, "key").select(*columns, F.lit("shingles").alias("route")).where(F.col("hamming") > RADIUS)
    both = by_blocks.unionByName(by_shingles)
    # From a generator, so that the costly similarity is not computed again in a filter.
    likeness = bound(similarity(F.col("shingles"), F.col("item_shingles")), lambda s: F.when(s >= similar, F.array(s)))
    close = both.select("*", F.explode(likeness).alias("similarity"))
    return close.select(
        "id", "text_hash", "item", F.col("start").cast("bigint").alias("start"), F.col("n").cast("bigint").alias("n_words"),
        "hamming", "similarity", "route",
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with no leak, with all their columns."""
    found = leaks(docs, benchmark, id_col, text_col, **how).select(F.col("id").alias("leak_id"), "text_hash").distinct()
    same = docs[id_col].eqNullSafe(found["leak_id"]) & (F.xxhash64(docs[text_col].cast("string")) == found["text_hash"])
    return docs.join(found, same, "left_anti")
