"""Quality of texts by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import fold_of, numbered_words, steps, texts_of
from sediment.llm.quality_rules import SYMBOLS, window_repeats

#: Hash buckets of words, factors of each feature, and the most labelled rows the model is fitted on.
BUCKETS, FACTORS, SAMPLE = 1 << 14, 8, 8_000
STEPS, BATCH, RATE, DECAY = 60, 400, 0.02, 1e-4
CLASS_AT = 0.7
STATISTICS = 12


@dataclass
class Model:
    """Bias, weight and factors of each feature, and how the dense features are scaled."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def statistics(text: bytes, numbers: np.ndarray) -> list[float]:
    """Structure of one text."""
    n, words = max(len(text), 1), max(len(numbers), 1)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        np.log1p(len(numbers)),
        np.log1p(len(text)),
        n / words,
        kinds[65:91].sum() / n,
        kinds[48:58].sum() / n,
        (len(text) - len(text.translate(None, SYMBOLS))) / n,
        kinds[[33, 63]].sum() / n,
        kinds[[44, 46]].sum() / n,
        1 - len(set(lines)) / max(len(lines), 1),
        window_repeats(numbers) / words,
        len(np.unique(numbers)) / words,
        len(lines) / words,
    ]


def features(part: pa.RecordBatch, text: int, metadata: Sequence[int]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each row: word buckets, their values (of length 1 together), and the dense features."""
    texts = [t or b"" for t in texts_of(part.column(text))]
    words, numbers, ends = numbered_words(texts)
    hashed = np.array([xxhash.xxh64_intdigest(w, 8) % BUCKETS for w in words], np.int64)
    extra = [np.nan_to_num(np.array(part.column(k).cast(pa.float64()).to_pylist(), float)) for k in metadata]
    extra = [np.sign(x) * np.log1p(np.abs(x)) for x in extra]
    buckets, values, dense = [], [], np.zeros((len(texts), STATISTICS + len(extra)))
    for k, t in enumerate(texts):
        own = numbers[ends[k] : ends[k + 1]]
        found, times = np.unique(hashed[own], return_counts=True)
        value = 1 + np.log(times)
        buckets.append(found)
        values.append(value / max(np.sqrt((value**2).sum()), 1e-9))
        dense[k] = [*statistics(t, own), *[x[k] for x in extra]]
    return buckets, values, dense


def scores(model: Model, buckets: list[np.ndarray], values: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    """Probability of label 1. Pairs cost linear time: sum_ij = (square of the sum - sum of squares) / 2."""
    scaled = (dense - model.mean) / model.scale
    hashed = BUCKETS + np.arange(dense.shape[1])
    out = np.empty(len(buckets))
    for k, (b, v) in enumerate(zip(buckets, values, strict=True)):
        index, x = np.concatenate([b, hashed]), np.concatenate([v, scaled[k]])
        own = model.factors[index] * x[:, None]
        out[k] = model.bias + model.weights[index] @ x + 0.5 * ((own.sum(axis=0) ** 2).sum() - (own**2).sum())
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(buckets: list[np.ndarray], values: list[np.ndarray], dense: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """At least ``STEPS`` Adam steps on the logistic loss over batches of rows, in a fixed order."""
    random = np.random.default_rng(seed)
    mean, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)
    hashed = BUCKETS + np.arange(dense.shape[1])
    rows = [np.concatenate([b, hashed]) for b in buckets]
    xs = [np.concatenate([v, d]) for v, d in zip(values, np.clip((dense - mean) / scale, -8, 8), strict=True)]
    size = BUCKETS + dense.shape[1]
    theta = np.concatenate([np.zeros((size, 1)), random.normal(0, 0.01, (size, FACTORS))], axis=1)
    bias, first, second, step = 0.0, np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(-(-STEPS * BATCH // len(rows))):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            index = np.concatenate([rows[k] for k in chosen])
            x = np.concatenate([xs[k] for k in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(rows[k]) for k in chosen])
            starts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            own = theta[index, 1:] * x[:, None]
            sums = np.add.reduceat(own, starts)
            raw = bias + np.add.reduceat(theta[index, 0] * x, starts)
            raw += 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((own**2).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / len(chosen)
            each = error[owner] * x
            slopes = np.concatenate([each[:, None], each[:, None] * (sums[owner] - own)], axis=1)
            slope = np.stack([np.bincount(index, slopes[:, f], size) for f in range(FACTORS + 1)], axis=1) + DECAY * theta
            step += 1
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            bias -= 5 * RATE * error.sum()
    return Model(float(bias), theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32), mean, scale)


def _inputs(docs: DataFrame, id_col: str, text_col: str, metadata: Sequence[str]) -> DataFrame:
    extra = [F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: Sequence[str] = ("n_chars",),
    sample: int = SAMPLE,
) -> Model:
    """Fit on at most ``sample`` labelled documents, those with the smallest hash of their id.

    Ids of fold 2 are left out. A document with several labels has the smallest; of rows that repeat
    an id one is used. The driver gets the features of these documents, never more. Without any
    labelled document every score is 0.5.
    """
    marked = labels.where("quality IN (0, 1)").where(fold_of(F.col("doc_id")) != 2)
    marked = marked.groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = _inputs(docs, id_col, text_col, metadata).join(F.broadcast(chosen), F.col("id") == F.col("key"))
    rows = rows.select("key", "quality", "text", *[f"m{k}" for k in range(len(metadata))])
    columns = list(range(3, 3 + len(metadata)))
    key_kind = rows.schema["key"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 2):
                buckets, values, dense = features(part, 2, columns)
                packed = [pa.array([a.astype(t).tobytes() for a in side], pa.binary()) for side, t in ((buckets, "<i4"), (values, "<f4"), (dense, "<f8"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(pa.int32()), *packed], ["key", "quality", "b", "v", "d"]
                )

    found = rows.mapInArrow(extract, f"key {key_kind}, quality int, b binary, v binary, d binary")
    one = F.min_by(F.struct("quality", "b", "v", "d"), F.xxhash64("b", "v", "d")).alias("one")
    got = found.groupBy("key").agg(one).select("key", "one.*").orderBy(F.xxhash64("key"), "key").collect()
    if not got:
        size, dense = BUCKETS + STATISTICS + len(metadata), STATISTICS + len(metadata)
        return Model(0.0, np.zeros(size), np.zeros((size, FACTORS)), np.zeros(dense), np.ones(dense))
    return fit(
        [np.frombuffer(r["b"], "<i4").astype(np.int64) for r in got],
        [np.frombuffer(r["v"], "<f4").astype(float) for r in got],
        np.stack([np.frombuffer(r["d"], "<f8") for r in got]),
        np.array([r["quality"] for r in got], float),
    )


def classify(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: Sequence[str] = ("n_chars",),
    at: float = CLASS_AT,
) -> DataFrame:
    """``id, score, predicted`` for every row; null texts count as empty ones, null metadata as 0.

    Repeated rows each have a result. Only the named columns are read.
    """
    rows = _inputs(docs, id_col, text_col, metadata)
    columns = list(range(2, 2 + len(metadata)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                found = scores(model, *_clipped(model, features(part, 1, columns)))
                verdict = pa.array((found >= at).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), verdict], ["id", "score", "predicted"])

    return rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int")


def _clipped(model: Model, found: tuple) -> tuple:
    buckets, values, dense = found
    return buckets, values, np.clip((dense - model.mean) / model.scale, -8, 8) * model.scale + model.mean
