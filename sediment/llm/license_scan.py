"""Licence statements recognised by their sentences.

Sentences and rules are tables. A text's lines meet the sentences by a hash of their first words, the
sentences found meet the rules by their first identifier; both are exact after that. A table that is
small by its bytes is sent to every task, a larger one is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.bitmap import Bitmap, bitmap_of, bound

#: Normalised sentences of public licence notices and the identifier of each.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2.0": "apache-2.0-notice",
    "you may not use this file except in compliance with the license": "apache-2.0-compliance",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "apache-2.0-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-permission",
    "the software is provided as is without warranty of any kind": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "licensed under the gnu general public license version 3": "gpl-3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "either version 3 of the license or at your option any later version": "gpl-3-later",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0-notice",
    "licensed under cc by 4.0": "cc-by-4.0-notice",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0-notice",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-permission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permission",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permission",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl-2.0-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl-2.0-copy",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "this is free and unencumbered software released into the public domain": "unlicense-dedication",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-permission",
    "all rights reserved": "rights-reserved",
    "licensed under the apache license version 2.0 the license": "apache-2.0-notice",
    "http www.apache.org licenses license-2.0": "apache-2.0-copy",
    "https www.apache.org licenses license-2.0": "apache-2.0-copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-permission",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
}
#: The GNU notices, of whose sentence a mark may cut off the beginning or the version.
_FSF = "as published by the free software foundation"
_LATER = "of the license or at your option any later version"
_GNU = [("gpl", "", ("2", "3")), ("lgpl", "lesser ", ("2.1", "3")), ("lgpl", "library ", ("2",)), ("agpl", "affero ", ("3",))]
SENTENCES |= {f"either version {v} {_LATER}": "gpl-3-later" if v == "3" else f"gnu-{v}-later" for v in ("2", "2.1", "3")}
SENTENCES |= {f"version {v} of the license": f"gnu-{v}-only" for v in ("2", "2.1", "3")}
for _start in ("this program is free software ", "this library is free software ", ""):
    for _id, _kind, _versions in _GNU:
        _terms = f"{_start}you can redistribute it and or modify it under the terms of the gnu {_kind}general public license"
        SENTENCES[f"{_terms} {_FSF}"] = f"{_id}-terms"
        for _v in _versions:
            SENTENCES[f"{_terms} {_FSF} either version {_v} {_LATER}"] = f"{_id}-{_v}-or-later-notice"
            SENTENCES[f"{_terms} {_FSF} version {_v} of the license"] = f"{_id}-{_v}-notice"
            SENTENCES[f"{_terms} version {_v} {_FSF}"] = f"{_id}-{_v}-notice"
#: The Creative Commons names.
for _start in ("licensed under", "this work is licensed under"):
    for _kind, _id in (("", "by"), ("-noncommercial", "by-nc"), ("-sharealike", "by-sa")):
        for _article in ("", "a ", "the "):
            for _end in ("", " license"):
                SENTENCES[f"{_start} {_article}creative commons attribution{_kind} 4.0 international{_end}"] = f"cc-{_id}-4.0-notice"
#: Who may not be named in advertising, by the third condition of a BSD licence.
for _who in ("the copyright holder", "the copyright holders", "the author"):
    for _whose in ("its", "their"):
        SENTENCES[f"neither the name of {_who} nor the names of {_whose} contributors may be used to endorse or promote products derived from this software without specific prior written permission"] = "bsd-endorsement"
#: Licences that a line ``SPDX-License-Identifier: <name>`` may state.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
SENTENCES |= {f"spdx-license-identifier {name.lower()}": f"spdx-{name}" for name in SPDX}
#: Ordered rules: the first whose identifiers occur one after another, others between them allowed or
#: not ("later" or "next"), names the licence. A longer rule stands before the one that it contains.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    *[(name, "next", (f"spdx-{name}",)) for name in SPDX],
    ("Apache-2.0", "later", ("apache-2.0-notice", "apache-2.0-compliance", "apache-2.0-copy")),
    ("Apache-2.0", "next", ("apache-2.0-notice",)),
    ("MIT", "later", ("mit-permission", "mit-warranty")),
    ("MIT", "next", ("mit-notice",)),
    ("GPL-3.0-or-later", "next", ("gpl-3-or-later-notice",)),
    ("GPL-3.0-or-later", "next", ("gpl-terms", "gpl-3-later")),
    ("GPL-2.0-or-later", "next", ("gpl-2-or-later-notice",)),
    ("GPL-2.0-or-later", "next", ("gpl-terms", "gnu-2-later")),
    ("GPL-3.0-or-later", "later", ("gpl-3-notice", "gpl-3-later")),
    ("GPL-3.0-only", "next", ("gpl-3-notice",)),
    ("GPL-3.0-only", "next", ("gpl-terms", "gnu-3-only")),
    ("GPL-2.0-only", "next", ("gpl-2-notice",)),
    ("GPL-2.0-only", "next", ("gpl-terms", "gnu-2-only")),
    ("LGPL-3.0-or-later", "next", ("lgpl-3-or-later-notice",)),
    ("LGPL-3.0-or-later", "next", ("lgpl-terms", "gpl-3-later")),
    ("LGPL-2.1-or-later", "next", ("lgpl-2.1-or-later-notice",)),
    ("LGPL-2.1-or-later", "next", ("lgpl-terms", "gnu-2.1-later")),
    ("LGPL-2.0-or-later", "next", ("lgpl-2-or-later-notice",)),
    ("LGPL-2.0-or-later", "next", ("lgpl-terms", "gnu-2-later")),
    ("LGPL-3.0-only", "next", ("lgpl-3-notice",)),
    ("LGPL-3.0-only", "next", ("lgpl-terms", "gnu-3-only")),
    ("LGPL-2.1-only", "next", ("lgpl-2.1-notice",)),
    ("LGPL-2.1-only", "next", ("lgpl-terms", "gnu-2.1-only")),
    ("AGPL-3.0-or-later", "next", ("agpl-3-or-later-notice",)),
    ("AGPL-3.0-or-later", "next", ("agpl-terms", "gpl-3-later")),
    ("AGPL-3.0-only", "next", ("agpl-3-notice",)),
    ("AGPL-3.0-only", "next", ("agpl-terms", "gnu-3-only")),
    ("MPL-2.0", "next", ("mpl-terms", "mpl-2.0-copy")),
    ("ISC", "next", ("isc-permission",)),
    ("0BSD", "next", ("0bsd-permission",)),
    ("CC-BY-NC-4.0", "next", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-SA-4.0", "next", ("cc-by-sa-4.0-notice",)),
    ("CC-BY-4.0", "next", ("cc-by-4.0-notice",)),
    ("CC0-1.0", "next", ("cc0-dedication",)),
    ("Unlicense", "next", ("unlicense-dedication",)),
    ("BSD-3-Clause", "next", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("BSD-2-Clause", "next", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD", "next", ("bsd-permission",)),
    ("Proprietary", "next", ("rights-reserved",)),
]
#: Sentences end at .!? or ; before white space, at a blank line, or at the end of the text. A line in
#: between may also end one: the longest run of lines that is a known sentence counts.
ENDS = r"[.!?;]+(?=\s)|\n[\s&&[^\n]]*\n"
#: A word of a sentence: letters and digits, with single dots or hyphens inside.
WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
#: Bytes up to which the table of sentences, and that of rules, is sent to every task.
BROADCAST_BYTES = 16 << 20


def normalised(text: Column) -> Column:
    """The words of a text in lower case, one space between them."""
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), " "))


def sentence_table(spark: SparkSession, sentences: Mapping[str, str] = SENTENCES) -> DataFrame:
    """``sentence, ident`` of a mapping."""
    return spark.createDataFrame(list(sentences.items()), "sentence string, ident string")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, Sequence[str]]] = RULES) -> DataFrame:
    """``rank, license, how, wanted`` of rules in their order."""
    rows = [(n, licence, how, list(wanted)) for n, (licence, how, wanted) in enumerate(rules)]
    return spark.createDataFrame(rows, "rank int, license string, how string, wanted array<string>")


def _leading(flat: Column, n: Column | int) -> Column:
    """The hash of the first ``n`` words."""
    return F.xxhash64(F.call_function("substring_index", flat, F.lit(" "), n if isinstance(n, Column) else F.lit(n)))


def prepared_sentences(table: DataFrame) -> DataFrame:
    """``sentence, ident, anchor``, one row per sentence in normal form; the least identifier if it has several."""
    rows = table.select(normalised(F.col("sentence")).alias("sentence"), "ident").where("sentence <> '' AND ident IS NOT NULL")
    rows = rows.groupBy("sentence").agg(F.min("ident").alias("ident"))
    return rows.withColumn("anchor", _leading(F.col("sentence"), 2))


def prepared_rules(table: DataFrame) -> DataFrame:
    """``rank, license, pattern, opener``: the pattern matches the joined identifiers of a text."""
    rows = table.where("rank IS NOT NULL AND license IS NOT NULL AND size(filter(wanted, w -> w IS NOT NULL)) > 0")
    between = F.when(F.col("how") == "next", ",").otherwise(",(?:.*,)?")
    quoted = F.transform("wanted", lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    pattern = F.concat(F.lit(","), F.call_function("array_join", quoted, between), F.lit(","))
    return rows.select("rank", "license", pattern.alias("pattern"), F.get("wanted", F.lit(0)).alias("opener"))


def _sent(table: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table


def _starts(part: Column, longest: int, first_words: Bitmap) -> Column:
    """``line, rest`` for each line of a part that may begin a known sentence.

    Lines without a word do not count; each other has one at least, so ``longest`` lines, joined by
    line ends in ``rest``, hold any known sentence.
    """

    def first_of(line: Column) -> Column:
        return F.xxhash64(F.lower(F.regexp_extract(line, WORD, 0)))

    def of_lines(lines: Column) -> Column:
        def start(line: Column, i: Column) -> Column:
            rest = F.array_join(F.slice(lines, i + 1, F.lit(longest)), "\n")
            return F.when(first_words.may_hold(first_of(line)), F.struct(i.alias("line"), rest.alias("rest")))

        return F.filter(F.transform(lines, start), lambda s: s.isNotNull())

    raw = F.split(part, "\n")
    lines = F.filter(F.transform(raw, normalised), lambda line: line != "")
    none = F.array().cast("array<struct<line: int, rest: string>>")
    return F.when(F.exists(raw, lambda line: first_words.may_hold(first_of(line))), bound(lines, of_lines)).otherwise(none)


def sentences_found(texts: DataFrame, table: DataFrame) -> DataFrame | None:
    """``id, hash, ids`` of those ``texts(id, hash, text)`` with a known sentence; None for an empty table.

    ``ids`` are the identifiers in the order of the text, repeats included. Of the known runs of lines
    that begin at a line the longest counts, and the search goes on after it. Rows of equal id and hash
    are one text.
    """
    known = prepared_sentences(table)
    words = F.size(F.split("sentence", " "))
    size = F.sum(F.octet_length("sentence") + F.octet_length("ident") + 64)
    longest, shortest, size = known.agg(F.max(words), F.min(words), size).first()
    firsts = known.select(F.xxhash64(F.substring_index("sentence", " ", 1)).alias("h"))
    first_words = bitmap_of(firsts.distinct(), "h")
    if first_words is None:
        return None
    parts = texts.select("id", "hash", F.posexplode(F.split("text", ENDS)).alias("part", "cut"))
    starts = parts.select("id", "hash", "part", F.explode(_starts(F.col("cut"), longest, first_words)).alias("s"))
    starts = starts.select("id", "hash", "part", "s.line", "s.rest", F.translate("s.rest", "\n", " ").alias("flat"))
    # a sentence of one word has that word as its anchor, any other its first two
    anchors = F.array(*[_leading(F.col("flat"), n) for n in ((1, 2) if shortest == 1 else (2,))])
    starts = starts.withColumn("anchor", F.explode(F.array_distinct(anchors)))
    hits = starts.join(_sent(known, size), "anchor")
    hits = hits.where(
        F.startswith(F.concat("flat", F.lit(" ")), F.concat("sentence", F.lit(" ")))
        & (F.substring(F.concat("rest", F.lit("\n")), F.length("sentence") + 1, F.lit(1)) == "\n")
    )
    taken = F.size(F.split(F.substring(F.col("rest"), F.lit(1), F.length("sentence")), "\n"))
    hit = F.struct("part", "line", (-F.length("sentence")).alias("shorter"), (F.col("line") + taken).alias("next"), "ident")

    def step(state: Column, m: Column) -> Column:
        free = (m["part"] > state["part"]) | (m["line"] >= state["next"])
        ids = F.concat(state["ids"], F.array(m["ident"]))
        return F.when(free, F.struct(m["part"].alias("part"), m["next"].alias("next"), ids.alias("ids"))).otherwise(state)

    first = F.struct(F.lit(-1).alias("part"), F.lit(0).alias("next"), F.array().cast("array<string>").alias("ids"))
    ordered = hits.groupBy("id", "hash").agg(F.sort_array(F.collect_set(hit)).alias("hits"))
    return ordered.select("id", "hash", F.aggregate("hits", first, step, lambda state: state["ids"]).alias("ids"))


def licences_of(found: DataFrame, table: DataFrame) -> DataFrame:
    """``id, hash, ids, licenses`` of ``found(id, hash, ids)``: the different licences whose rules match, in the rules' order."""
    rules = prepared_rules(table)
    size = rules.agg(F.sum(F.octet_length("license") + F.octet_length("pattern") + F.octet_length("opener") + 64)).first()[0]
    asked = found.select("id", "hash", "ids", F.explode(F.array_distinct("ids")).alias("opener"))
    joined = asked.join(_sent(rules, size), "opener", "left")
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    match = F.when(F.rlike(line, F.col("pattern")), F.struct("rank", "license"))
    rows = joined.groupBy("id", "hash").agg(F.first("ids").alias("ids"), F.sort_array(F.collect_set(match)).alias("m"))
    return rows.select("id", "hash", "ids", F.array_distinct(F.transform("m", lambda m: m["license"])).alias("licenses"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: DataFrame | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """``id, sentences, licenses, license`` for every row.

    ``sentences`` are the identifiers of the known licence sentences of the whole text in order;
    ``licenses`` the different licences whose rules match, in the rules' order; ``license`` the first,
    ``unknown`` if there are sentences that make no rule, ``none`` without any. The tables are those of
    ``sentence_table`` and ``rule_table`` unless given. Null and empty texts have none. Ids may be null
    or repeat; equal rows have equal results, each its own row. An empty table of documents gives no
    rows, an empty table of sentences ``none`` for all. Only the two named columns are read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rows = texts.select("id", "hash")
    found = sentences_found(texts, sentence_table(spark) if sentences is None else sentences)
    if found is None:
        return rows.select("id", F.lit("").alias("sentences"), F.lit("").alias("licenses"), F.lit("none").alias("license"))
    named = licences_of(found, rule_table(spark) if rules is None else rules).withColumnsRenamed({"id": "key", "hash": "key_hash"})
    rows = rows.join(named, F.col("id").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("key_hash")), "left")
    license = F.when(F.size("licenses") > 0, F.get("licenses", F.lit(0))).when(F.col("ids").isNotNull(), "unknown").otherwise("none")
    joined = [F.coalesce(F.array_join(c, ","), F.lit("")).alias(n) for c, n in (("ids", "sentences"), ("licenses", "licenses"))]
    return rows.select("id", *joined, license.alias("license"))
