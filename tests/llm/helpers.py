"""Small corpora and plain Python versions that the corpus operators are compared with."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Nulls, empty texts, ties, repeated rows and columns whose names clash with results.
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, None, None),
    (4, "One", "en", "s", 3),
    (5, "one two three four five six seven", "en", "s", 30),
    (5, "one two three four five six seven", "en", "s", 30),
    (6, "ONE two\tthree four\nfive six seven", "en", "s", 30),
    (None, "one two three four five six seven", "en", "s", 30),
    (7, "word " * 60_000, "en", "s", 300_000),
    (8, "élan vital 中文 😀 ñandú", "fr", "s", 22),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "row", "fp", "base", "kept", "tokens", "key", "hash", "rank", "keep", "n", "part"]


def odd_docs(spark, clash=True):
    docs = spark.createDataFrame(ODD, COLUMNS)
    if clash:
        docs = docs.selectExpr("*", *[f"{k} AS {name}" for k, name in enumerate(CLASHING)])
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def shingles(some_words, size):
    return [tuple(some_words[i : i + size]) for i in range(max(1, len(some_words) - size + 1))]


def weighted(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    return sum((a & b).values()) / sum((a | b).values())
