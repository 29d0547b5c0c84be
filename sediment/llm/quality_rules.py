"""Rule counts of a text, and its n-grams' likelihood under trusted text against the raw corpus.

Like is compared with like: the raw corpus is re-weighted to the mix of the trusted text, so a language
with fewer labels is not worse for it. What belongs together is found from the texts alone: frequent
n-grams that stand in the same texts are a stratum. Copies of a text count as one text. Smoothing follows the
amount of trusted text, and the threshold is a quantile of the trusted texts' own scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.bitmap import bitmap_of
from sediment.llm.common import numbered_words, steps, stored, texts_of

#: Hash buckets of n-grams.
BUCKETS = 1 << 16
#: What is added to both sides of a bucket's ratio, in average trusted n-grams of a bucket: few observations,
#: as of a rare word, then say little against a text.
SMOOTHING = 2.0
#: The share of the trusted texts of a stratum, each scored without its own n-grams, that scores below its
#: threshold, and the fewest of them that set one; strata with fewer take the threshold of all.
QUANTILE, LEAST_TRUSTED = 0.01, 30
#: Frequent n-grams that strata are made of, the least share of their texts that those of two groups have in
#: common on average when they are joined, and the fewest that make a stratum.
FREQUENT, TOGETHER, LEAST_GRAMS = 256, 0.3, 3
#: A stratum is re-weighted if its share of the trusted text is at least this part of its share of the raw text.
COMPARABLE = 0.25
#: Texts with more than one row in so many are counted once; there are at most as many.
COPIES = 10_000
#: Weights of texts are whole numbers of this unit, so that sums do not depend on their order.
UNIT = 1 << 20
#: Text that one step of a task handles at once.
STEP = 1 << 20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_repeats(numbers: np.ndarray, window: int = 3) -> int:
    """Words of a text that lie in a window of words which occurs twice or more in it."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    code = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    kinds, own = int(code.max()) + 1, code
    for k in range(1, window):
        code = code[:-1] * kinds + own[k:]
        if k < window - 1:  # stay below kinds * rows, which fits
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    marked = np.zeros(len(numbers), bool)
    for k in range(window):
        marked[k : k + n] |= twice
    return int(marked.sum())


def base_counts(text: bytes | None, numbers: np.ndarray) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    letters = text.translate(None, b" \t\n\x0b\x0c\r")
    chars = int(np.count_nonzero((np.frombuffer(letters, np.uint8) & 0xC0) != 0x80)) if letters else 0
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()] if b"\n" in text else []
    return len(numbers), chars, symbols, len(lines) - len(set(lines)), window_repeats(numbers)


def ngrams(words: list[bytes], numbers: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word and every pair of neighbours, the text that each belongs to)."""
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[numbers] if words else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = text[:-1] == text[1:]
    pairs = (own[:-1] * _MIX[0] + own[1:] * _MIX[1])[inside]
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    grams = np.concatenate([own * _MIX[1], pairs * _MIX[0]]) >> shift
    return grams.astype(np.int64), np.concatenate([text, text[:-1][inside]])


@dataclass
class Strata:
    """The stratum of each bucket (-1: of none) and the weight of each stratum's raw texts, 0 for texts of none."""

    of_bucket: np.ndarray
    weights: np.ndarray

    def of_texts(self, grams: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """The stratum that most of a text's frequent n-grams are of; the last one if it has none."""
        kinds = len(self.weights) - 1
        own = self.of_bucket[grams]
        hits = np.bincount(text[own >= 0] * kinds + own[own >= 0], minlength=texts * kinds).reshape(texts, kinds) if kinds else np.zeros((texts, 1))
        return np.where(hits.max(axis=1) > 0, hits.argmax(axis=1), kinds)


@dataclass
class Model:
    """log p(bucket | trusted) / p(bucket | raw), and the least mean of them that a text of each stratum is kept with."""

    ratios: np.ndarray
    strata: Strata
    thresholds: np.ndarray


def _summed(rows: Weighed, places: int, count) -> np.ndarray:
    """The ``places`` sums that ``count(texts, weights, total)`` adds to an array in each task.

    The driver gets the sums that are not zero.
    """
    frame, copies = rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places, np.int64)
        for batch in batches:
            for part in steps(batch, 0, STEP):
                weights = [max(1, UNIT // copies.get(h, 1)) for h in part.column(1).to_pylist()]
                count(texts_of(part.column(0)), np.array(weights, np.int64), total)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], ["place", "n"])

    found = frame.mapInArrow(task, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(places)
    sums[found["place"].to_numpy()] = found["n"].to_numpy()
    return sums


#: Texts with their hashes, and the rows of those hashes that have many.
Weighed = tuple[DataFrame, dict[int, int]]


def weighed(docs: DataFrame, copies: dict[int, int], text_col: str = "text") -> Weighed:
    """Texts of which those with many copies share the weight of one."""
    text = F.col(text_col).cast("string")
    return docs.select(text.alias("text"), F.xxhash64(text).alias("h")), copies


def many_copies(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Hash and rows of each text with more than one row in ``COPIES``: at most that many texts."""
    hashes = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    counts = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    least = max(1, docs.count() / COPIES)
    return {r["h"]: r["n"] for r in counts.where(F.col("n") > least).collect()}


def gram_sums(rows: Weighed, buckets: int, strata: Strata | None = None) -> np.ndarray:
    """Weighted n-grams of each bucket; with ``strata``, a row of them for each stratum of texts."""
    kinds = len(strata.weights) if strata is not None else 1

    def count(texts, weights, total):
        grams, text = ngrams(*numbered_words(texts), buckets)
        if strata is not None:
            grams = grams + strata.of_texts(grams, text, len(texts))[text] * buckets
        # Whole numbers below 2^53 are exact in double precision.
        total += np.bincount(grams, weights[text], len(total)).astype(np.int64)

    sums = _summed(rows, kinds * buckets, count)
    return sums.reshape(kinds, buckets) if strata is not None else sums


def strata_of(raw: Weighed, counts: np.ndarray) -> np.ndarray:
    """The stratum of each bucket, -1 for most: groups of the most frequent ones that stand in the same texts."""
    top = np.argsort(-counts, kind="stable")[:FREQUENT]
    top = top[counts[top] > 0]
    place = np.full(len(counts), -1)
    place[top] = np.arange(len(top))
    kinds = len(top)

    def count(texts, weights, total):
        grams, text = ngrams(*numbered_words(texts), len(place))
        own = place[grams]
        held = np.zeros((len(texts), kinds))
        held[text[own >= 0], own[own >= 0]] = 1
        total += np.rint((held * (weights // 1024)[:, None]).T @ held).astype(np.int64).ravel()

    together = _summed(raw, kinds * kinds, count).reshape(kinds, kinds)
    alone = together.diagonal()
    near = together / np.maximum(np.maximum(alone[:, None], alone[None, :]), 1)
    of_bucket, number = np.full(len(counts), -1), 0
    for members in grouped(near, TOGETHER):
        if len(members) >= LEAST_GRAMS:
            of_bucket[top[members]] = number
            number += 1
    return of_bucket


def grouped(near: np.ndarray, least: float) -> list[list[int]]:
    """Groups joined while the mean nearness of two groups' members is ``least`` or more, nearest first.

    By the mean, a word that two languages share does not join them.
    """
    groups = [[k] for k in range(len(near))]
    sums, sizes = near.copy(), np.ones(len(near))
    np.fill_diagonal(sums, -np.inf)
    while len(near) > 1:
        mean = sums / (sizes[:, None] * sizes[None, :])
        a, b = sorted(divmod(int(mean.argmax()), len(near)))
        if mean[a, b] < least:
            break
        groups[a] += groups[b]
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        sums[b] = sums[:, b] = sums[a, a] = -np.inf
        sizes[a], groups[b] = sizes[a] + sizes[b], []
    return [sorted(g) for g in groups if g]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> Model:
    """Ratios and threshold from all rows of ``docs`` and all with a label of quality 1.

    The driver gets sums of a fixed size (buckets, pairs of frequent buckets, strata), whatever the input.
    Without trusted text all ratios are 0 and every text that passes the base rules is kept.
    """
    trusted = stored(trusted_texts(docs, labels, id_col, text_col), "trusted-texts")
    copies = many_copies(docs, text_col)
    raw, good = weighed(docs, copies, text_col), weighed(trusted, many_copies(trusted, text_col), text_col)
    of_bucket = strata_of(raw, gram_sums(raw, buckets))
    strata = Strata(of_bucket, np.ones(of_bucket.max() + 2))
    raw_sums, seen = gram_sums(raw, buckets, strata), gram_sums(good, buckets, strata)
    whole, own = raw_sums.sum(axis=1), seen.sum(axis=1)
    if not own.sum():
        return Model(np.zeros(buckets), strata, np.zeros(len(strata.weights)))
    share = (own / own.sum()) / np.maximum(whole / whole.sum(), 1e-300)
    strata.weights = np.where(share >= COMPARABLE, share, 1.0)
    strata.weights[-1] = 1.0
    seen, raw_sums = seen.sum(axis=0), (raw_sums * strata.weights[:, None]).sum(axis=0)
    expected = raw_sums * (seen.sum() / max(raw_sums.sum(), 1))
    smoothing = SMOOTHING * seen.sum() / buckets
    ratios = np.log((seen + smoothing) / (expected + smoothing))
    return Model(ratios, strata, _thresholds(trusted, text_col, strata, seen, expected, smoothing))


def _thresholds(trusted: DataFrame, text_col: str, strata: Strata, seen: np.ndarray, expected: np.ndarray, smoothing: float) -> np.ndarray:
    """For each stratum the quantile of the scores of its trusted texts that pass the base rules."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0, STEP):
                texts = texts_of(part.column(0))
                words, numbers, ends = numbered_words(texts)
                grams, text = ngrams(words, numbers, ends, len(seen))
                code, inverse, own = np.unique(text * len(seen) + grams, return_inverse=True, return_counts=True)
                bucket = code % len(seen)
                others = np.maximum(seen[bucket] - own * float(UNIT), 0)
                ratios = np.log((others + smoothing) / (expected[bucket] + smoothing))
                sizes = np.bincount(text, minlength=len(texts))
                scores = np.bincount(text, ratios[inverse], len(texts)) / np.maximum(sizes, 1)
                bounds = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
                base = np.array([base_counts(t, numbers[a:b]) for t, (a, b) in zip(texts, bounds, strict=True)], np.int64).reshape(-1, 5)
                own, passed = strata.of_texts(grams, text, len(texts)), ~_failed(base)
                yield pa.RecordBatch.from_arrays([pa.array(own[passed]), pa.array(scores[passed])], ["stratum", "score"])

    rows = trusted.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scored, "stratum bigint, score double")
    least = F.percentile_approx("score", QUANTILE, 100_000).alias("least")
    found = rows.rollup("stratum").agg(least, F.count(F.lit(1)).alias("n")).collect()
    whole = next((r["least"] for r in found if r["stratum"] is None and r["least"] is not None), 0.0)
    thresholds = np.full(len(strata.weights), whole)
    for r in found:
        if r["stratum"] is not None and r["n"] >= LEAST_TRUSTED:
            thresholds[r["stratum"]] = r["least"]
    return thresholds


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of documents that have labels of quality 1 and no other.

    A bitmap of their ids leaves most other texts where they are; the rest are dealt by id and sorted.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("good"))
    good = stored(marked.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 AND high = 1").select("good"), "trusted-ids")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col))
    ids = bitmap_of(good.select(F.xxhash64(F.col("good").cast("string")).alias("h")), "h")
    if ids is None:
        return rows.where("false").select(text_col)
    some = rows.where(ids.may_hold(F.xxhash64(F.col("id").cast("string"))))
    return some.join(good.hint("merge"), F.col("id") == F.col("good"), "left_semi").select(text_col)


def _failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEATED_PERCENT * base[:, 0])


def verdicts(texts: list[bytes | None], model: Model) -> tuple[np.ndarray, ...]:
    """Base counts (a row for each text), base_failed, score and kept."""
    words, numbers, ends = numbered_words(texts)
    grams, text = ngrams(words, numbers, ends, len(model.ratios))
    sums, sizes = np.bincount(text, model.ratios[grams], len(texts)), np.bincount(text, minlength=len(texts))
    scores = sums / np.maximum(sizes, 1)
    bounds = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    rows = [base_counts(t, numbers[a:b]) for t, (a, b) in zip(texts, bounds, strict=True)]
    base = np.array(rows, np.int64).reshape(-1, 5)
    failed = _failed(base)
    return base, failed, scores, ~failed & (scores >= model.thresholds[model.strata.of_texts(grams, text, len(texts))])


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the base counts, ``base_failed``, ``score`` and ``kept`` for every row.

    ``score`` is the mean log ratio of the text's words and pairs of words, 0 without a word. A row
    is kept if it has 50 words or more, at most half of them in repeated windows, and a score of its
    stratum's threshold or more. Null and empty texts have no words and fail. Repeated rows each have a
    result. Only the two named columns are read.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1, STEP):
                base, *rest = verdicts(texts_of(part.column(1)), model)
                columns = [part.column(0), *map(pa.array, [*base.T.copy(), *rest])]
                yield pa.RecordBatch.from_arrays(columns, ["id", *counts, "base_failed", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = ", ".join(f"{c} bigint" for c in counts)
    return rows.mapInArrow(judged, f"id {kind}, {fields}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; ties, repeats and null ids change nothing."""
    return only_kept(docs, learn(docs, labels, id_col, text_col), text_col)


def only_kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows are judged as they pass with all their columns, so nothing is joined afterwards. An empty table gives none."""
    column = docs.columns.index(text_col)

    def pass_good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, column, STEP):
                *_, kept = verdicts(texts_of(part.column(column)), model)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(pass_good, docs.schema)
