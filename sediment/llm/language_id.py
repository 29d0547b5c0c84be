"""Language of texts and of spans in them: scripts, letter n-grams and a Viterbi path over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import fold_of, numbered_words, steps, texts_of

#: Hash buckets of n-grams, their lengths in bytes, and what is added to each count.
BUCKETS, ORDERS, SMOOTHING = 1 << 15, (2, 3, 4), 0.5
#: What a change of language costs between two words, in units of log probability.
SWITCH = 12.0
#: Words of a block of a long text.
BLOCK_WORDS = 4096
#: A script is a language's own if so large a share of its words is written in it.
OWN_SCRIPT = 0.001
STEP = 8 << 20
UNKNOWN = "und"
#: Where blocks of scripts start in Unicode; the last one before a letter holds it.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2C00, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    """``languages``, log probabilities of n-grams by bucket and language, and scripts of each language."""

    languages: list[str]
    grams: np.ndarray
    scripts: np.ndarray


def letters_of(words: list[bytes]) -> list[str]:
    """The letters of each word in lower case."""
    return [NOT_LETTERS.sub("", w.decode(errors="replace")).lower() for w in words]


def word_grams(letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of all n-grams of all words; word ends count as a byte."""
    padded = [f" {w} ".encode() for w in letters]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(padded)), sizes)
    buckets, owners = [], []
    code = data
    for n in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint32(8)) | data[n - 1 :]
        if n in ORDERS:
            inside = owner[: len(code)] == owner[n - 1 :]
            mixed = (code[inside] + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            buckets.append((mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - (BUCKETS.bit_length() - 1)))
            owners.append(owner[: len(code)][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def script_numbers(letters: list[str]) -> np.ndarray:
    """The script of each word's first letter; -1 without a letter."""
    firsts = np.array([ord(w[0]) if w else -1 for w in letters], np.int64)
    found = SCRIPT_OF[np.maximum(np.searchsorted(STARTS, firsts, side="right") - 1, 0)]
    return np.where(firsts < 0, -1, found)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count n-grams and scripts of every text with a language whose id is not in fold 2.

    Each task sums its own rows; the driver gets ``BUCKETS`` numbers and the scripts per language.
    """
    rows = docs.select(fold_of(F.col(id_col)).alias("fold"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL AND fold <> 2 AND text IS NOT NULL").select("lang", "text")
    width = BUCKETS + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch):
                languages = np.array(part.column(0).to_pylist(), object)
                words, numbers, ends = numbered_words(texts_of(part.column(1)))
                if not words:
                    continue
                letters = letters_of(words)
                grams, owner = word_grams(letters)
                scripts = script_numbers(letters)
                text = np.repeat(np.arange(len(languages)), np.diff(ends))
                for language in set(languages):
                    own = numbers[(languages == language)[text]]
                    times = np.bincount(own, minlength=len(words)) * (scripts >= 0)
                    total = totals.setdefault(language, np.zeros(width))
                    total[:BUCKETS] += np.bincount(grams, times[owner], BUCKETS)
                    total[BUCKETS:] += np.bincount(np.maximum(scripts, 0), times, len(NAMES))
        for language, total in totals.items():
            found = np.flatnonzero(total)
            names = pa.array([language] * len(found), pa.string())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(found.astype(np.int32)), pa.array(total[found].astype(np.int64))], ["lang", "bucket", "n"]
            )

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in found})
    counts = np.zeros((width, len(languages)))
    for r in found:
        counts[r["bucket"], languages.index(r["lang"])] = r["n"]
    grams, scripts = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS:]
    own = scripts > OWN_SCRIPT * np.maximum(scripts.sum(axis=0), 1)
    own |= ~own.any(axis=1, keepdims=True)  # a script of no language leaves all of them
    return Model(languages, (np.log(grams) - np.log(grams.sum(axis=0))).astype(np.float32), own)


def word_scores(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each word in each language, whether it has a letter)."""
    letters = letters_of(words)
    scripts = script_numbers(letters)
    grams, owner = word_grams(letters)
    scores = np.stack(
        [np.bincount(owner, model.grams[grams, k], len(words)) for k in range(len(model.languages))], axis=1
    ) / len(ORDERS)
    scores[~model.scripts[np.maximum(scripts, 0)]] -= 1e4
    return scores.astype(np.float32), scripts >= 0


def _active(lengths: np.ndarray) -> np.ndarray:
    """How many of the lengths, longest first, are more than t, for each t."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")


def _advance(scores, starts, lengths, switch: float, values: np.ndarray, back: np.ndarray | None) -> np.ndarray:
    """The values of the languages after runs of words that begin with ``values``; where each came from into ``back``."""
    order = np.argsort(-lengths, kind="stable")
    starts, value, own = starts[order], values[order], np.arange(scores.shape[1])
    for t, n in enumerate(_active(lengths[order]).tolist()):
        now, at = value[:n], starts[:n] + t
        best = now.argmax(axis=1)
        moved = now[np.arange(n), best][:, None] - switch
        if back is not None:
            back[at] = np.where(moved > now, best[:, None], own)
        value[:n] = np.maximum(now, moved) + scores[at]
    out = np.empty_like(value)
    out[order] = value
    return out


def _follow(back, path, starts, lengths, last) -> None:
    """Write the paths of runs of words that end in the languages ``last``."""
    order = np.argsort(-lengths, kind="stable")
    starts, last, active = starts[order], last[order], _active(lengths[order])
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        path[at] = last[:n]
        last[:n] = back[at, last[:n]]


def _block_values(scores, cuts: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """For the blocks of a long text: the values before each, and the language that its best path ends in."""
    kinds, n = scores.shape[1], len(cuts) - 1
    # What a language before a block is worth to each language at its end, from one start at a time.
    worth = np.empty((n, kinds, kinds))
    before = np.where(np.eye(kinds, dtype=bool), 0.0, -1e30)
    step = max(1, (1 << 22) // kinds**2)
    for k in range(0, n, step):
        some = slice(k, min(k + step, n))
        m = some.stop - k
        starts, lengths = (np.repeat(x[some], kinds) for x in (cuts[:-1], np.diff(cuts)))
        worth[some] = _advance(scores, starts, lengths, switch, np.tile(before, (m, 1)), None).reshape(m, kinds, kinds)
    values = np.zeros((n + 1, kinds))
    for k in range(n):
        values[k + 1] = (values[k][:, None] + worth[k]).max(axis=0)
    last = np.empty(n, np.int64)
    last[-1] = values[-1].argmax()
    for k in range(n - 1, 0, -1):
        last[k - 1] = (values[k] + worth[k][:, last[k]]).argmax()
    return values[:-1], last


def best_paths(scores: np.ndarray, ends: np.ndarray, switch: float, block: int = BLOCK_WORDS) -> np.ndarray:
    """The language of each word on the best path of each text; all texts advance together.

    A text of more than four blocks of words is cut into blocks, which advance together as well: the steps
    are as many as a few blocks have words, however long a text is.
    """
    kinds = scores.shape[1]
    small = np.min_scalar_type(max(kinds - 1, 1))
    path, back = np.zeros(len(scores), small), np.zeros(scores.shape, small)
    sizes = np.diff(ends)
    short = sizes <= 4 * block
    starts, lengths = [ends[:-1][short]], [sizes[short]]
    values, lasts = [np.zeros((int(short.sum()), kinds))], []
    for text in np.flatnonzero(~short).tolist():
        cuts = np.append(np.arange(ends[text], ends[text + 1], block), ends[text + 1])
        before, last = _block_values(scores, cuts, switch)
        starts.append(cuts[:-1])
        lengths.append(np.diff(cuts))
        values.append(before)
        lasts.append(last)
    starts, lengths = np.concatenate(starts), np.concatenate(lengths)
    after = _advance(scores, starts, lengths, switch, np.concatenate(values), back)
    last = np.concatenate([after[: int(short.sum())].argmax(axis=1), *lasts]) if len(starts) else np.zeros(0, np.int64)
    _follow(back, path, starts, lengths, last)
    return path


def identify(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    switch: float = SWITCH,
    spans: bool = True,
) -> DataFrame:
    """``id, lang_pred, score`` and, with ``spans``, the text's spans, for every row.

    A word's script narrows the languages it can be in; its n-grams score the rest; the best path
    over the words pays ``switch`` for each change. A span has a first and last word, counted from 0
    among the words with a letter, and its language. ``lang_pred`` is the language of most of these
    words (the first by name on a tie), ``score`` its share of them. Null texts and texts without a
    letter, and all texts if nothing was learned, are ``und`` with score 0. Repeated rows each have a
    result. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "lang_pred", "score"] + ["spans"] * spans
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1, STEP):
                yield label(part)

    def label(part: pa.RecordBatch) -> pa.RecordBatch:
        words, numbers, ends = numbered_words(texts_of(part.column(1)))
        rows = part.num_rows
        predicted, shares = [UNKNOWN] * rows, np.zeros(rows)
        found: list[list[dict]] = [[] for _ in range(rows)]
        if words and model.languages:
            scores, letter = word_scores(words, model)
            used = letter[numbers]
            text = np.repeat(np.arange(rows), np.diff(ends))[used]
            numbers = numbers[used]
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=rows))))
            path = best_paths(scores[numbers], ends, switch)
            kinds = len(model.languages)
            counts = np.bincount(text * kinds + path.astype(np.int64), minlength=rows * kinds).reshape(rows, kinds)
            total = counts.sum(axis=1)
            best = counts.argmax(axis=1)
            shares = counts[np.arange(rows), best] / np.maximum(total, 1)
            predicted = [model.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)]
            if spans:
                cuts = np.flatnonzero((np.diff(path) != 0) | (np.diff(text) != 0)) + 1
                firsts = np.concatenate(([0], cuts))[: len(path)]
                lasts = np.concatenate((cuts, [len(path)]))[: len(firsts)] - 1
                for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
                    at = int(ends[text[a]])
                    found[text[a]].append({"first": a - at, "last": b - at, "lang": model.languages[path[a]]})
        columns = [part.column(0), pa.array(predicted, pa.string()), pa.array(shares)]
        return pa.RecordBatch.from_arrays(columns + [pa.array(found, span_type)] * spans, names)

    span_field = ", spans array<struct<first: bigint, last: bigint, lang: string>>"
    return rows.mapInArrow(labelled, f"id {kind}, lang_pred string, score double" + span_field * spans)
