"""Personal data in texts, and terms that reveal it by how they occur with it in the corpus.

Everything is DataFrame functions. Patterns find the protected entities. The corpus tells how much of
an entity's information a term carries: the pointwise mutual information of term and entity, over
lines as contexts, against the information of the entity itself. Few sightings weigh less, by a lower
confidence bound, but no number of them is too small. Terms above a threshold are taken out like the
entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.bitmap import Bitmap, bitmap_of, bound
from sediment.llm.common import stored

#: A term discloses an entity from this share of the entity's information on ...
DISCLOSES = 0.8
#: ... when the share of its lines that hold the entity is taken at the lower end of a one-sided 95 % interval.
CONFIDENCE = 1.645
#: A longer line is cut at white space into contexts of at most so many code points.
CONTEXT = 2000
#: The first count of a term looks at the lines of one hash in so many.
PART = 16
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", TERM: "[TERM]"}

# The look-behinds and possessive repeats find the same matches as the plain patterns, in linear time
# and without deep recursion: a match may only start where a run of its first characters starts, or
# where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
NOT_LETTERS = r"[^\p{L}]+"


def _gate(kind: str, text: Column) -> Column:
    """False only if the text has no valid match of the kind."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": text.rlike(r"\+[0-9]"),
    }[kind]


def luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.length(digits).between(14, 19) & luhn(digits)


def matches(text: Column, pattern: Column | str) -> Column:
    """``start, end, hit`` of the leftmost matches that do not overlap; code points, end exclusive."""

    def placed(x: Column) -> Column:
        def next_one(done: Column, y: Column) -> Column:
            start = done["at"] + F.length(y["gap"])
            end = start + F.length(y["hit"])
            one = F.struct(start.alias("start"), end.alias("end"), y["hit"].alias("hit"))
            return F.struct(end.alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

        empty = F.array().cast("array<struct<start: int, end: int, hit: string>>")
        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        pairs = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.when(F.size(x["hits"]) > 0, F.aggregate(pairs, zero, next_one)["out"]).otherwise(empty)

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return bound(F.struct(F.call_function("split", text, pattern, F.lit(-1)).alias("gaps"), hits.alias("hits")), placed)


def base_spans(text: Column) -> Column:
    """``start, rank, kind, end, hit`` of all valid matches of the four kinds, in order."""
    empty = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int, hit: string>>")
    found = [F.when(_gate(k, text), _named(F.filter(matches(text, PATTERNS[k]), _test(k)), k)).otherwise(empty) for k in KINDS]
    return F.array_sort(F.concat(*found))


def _test(kind: str):
    return lambda m: _valid(kind, m["hit"])


def _named(spans: Column, kind: str) -> Column:
    rank = F.lit([*KINDS, TERM].index(kind)).alias("rank")
    return F.transform(
        spans,
        lambda m: F.struct(m["start"].alias("start"), rank, F.lit(kind).alias("kind"), m["end"].alias("end"), m["hit"].alias("hit")),
    )


def any_gate(text: Column) -> Column:
    out = _gate(KINDS[0], text)
    for kind in KINDS[1:]:
        out = out | _gate(kind, text)
    return out


def contexts(docs: DataFrame, text_col: str) -> DataFrame:
    """``line`` of every text, repeats included; long ones in pieces that depend on the line alone."""
    whole = F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line")
    cut = F.regexp_extract_all("line", F.lit(rf"(?s).{{1,{CONTEXT}}}(?=\s|\z)|.{{1,{CONTEXT}}}"), F.lit(0))
    pieces = F.when(F.length("line") > CONTEXT, cut).otherwise(F.array("line"))
    return docs.select(whole).select(F.explode(pieces).alias("line"))


def entity_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """``id, entities, terms`` of the different lines with an entity; no match crosses a line's end."""
    lines = contexts(docs.where(any_gate(F.col(text_col).cast("string"))), text_col)
    lines = lines.where(any_gate(F.col("line"))).select(F.xxhash64("line").alias("id"), "line").dropDuplicates(["id"])

    def named(m: Column) -> Column:
        same = F.when(m["kind"] == "email", F.lower(m["hit"])).otherwise(F.regexp_replace(m["hit"], "[^0-9]", ""))
        return F.concat_ws(":", m["kind"], F.when(m["kind"] == "ip", m["hit"]).otherwise(same))

    rest = F.col("line")
    for kind in KINDS:
        rest = F.regexp_replace(rest, F.lit(PATTERNS[kind]), F.lit(" "))
    found = lines.select("id", F.array_distinct(F.transform(base_spans(F.col("line")), named)).alias("entities"), terms_of(rest).alias("terms"))
    return found.where(F.size("entities") > 0)


def terms_of(text: Column) -> Column:
    """The different runs of letters of a text in lower case; how rare one is decides, not its length."""
    runs = F.split(F.lower(text), NOT_LETTERS)
    return F.array_distinct(F.filter(runs, lambda t: t != ""))


def _sure_part(hits: Column, n: Column, z: float) -> Column:
    """The lower end of the score interval of the share ``hits / n``."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def _most_lines(hits: Column, part: Column, z: float) -> Column:
    """The largest n, not rounded, for which the lower end of ``hits / n`` is still ``part``."""
    spread = z * F.sqrt(part * (1 - part))
    root = (F.sqrt(spread * spread + 4 * part * hits) - spread) / (2 * part)
    return root * root * (1 + 1e-9)


def disclosing_terms(docs: DataFrame, text_col: str = "text", discloses: float = DISCLOSES, confidence: float = CONFIDENCE) -> DataFrame | None:
    """``term, share``: the terms that disclose an entity; None if none comes into question.

    share = log(p N / n(e)) / log(N / n(e)), the largest over the entities e, where p is the lower end
    of the score interval, ``confidence`` deviations wide, of n(t,e) / n(t). n counts different lines
    with the entity, with both, and with the term, N different lines with a letter. An entity that is
    in all N lines has no information to disclose. No count is too small to be weighed: a name seen
    once, beside an address seen once, discloses it if N is large enough.
    """
    lines = stored(entity_lines(docs, text_col), "entity-lines")
    total = contexts(docs, text_col).where(F.col("line").rlike(r"\p{L}")).select(F.xxhash64("line")).distinct().count()
    entities = lines.select("id", F.explode("entities").alias("entity"))
    known = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") < total)
    ready = entities.join(known, "entity").select("id", "entity", "n_e")
    pairs = ready.join(lines.select("id", "terms"), "id").select("entity", "n_e", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.first("n_e").alias("n_e"), F.count(F.lit(1)).alias("n_te"))
    # n(t) is at least the number of lines with an entity that hold t, and at least that of all lines
    # with certain hashes. Where one of these alone makes the share too small, as for every common
    # word, the term need not be counted in the whole corpus. No term is lost by this.
    held = lines.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("least"))
    rarity = F.lit(float(total)) / F.col("n_e")
    most = _most_lines(F.col("n_te"), F.pow(rarity, F.lit(discloses - 1)), confidence)
    pairs = pairs.withColumn("most", most).join(held, "term").where("least <= most").drop("least")
    pairs = stored(pairs, "entity-terms")
    for part in (PART, 1):
        wanted = pairs.select("term").distinct()
        bitmap = bitmap_of(wanted.select(F.xxhash64("term").alias("h")), "h")
        if bitmap is None:
            return None
        counted = corpus_counts(docs, text_col, wanted, bitmap, part)
        if part > 1:
            few = pairs.join(counted, "term", "left").where("coalesce(n_t, 0) <= most").drop("n_t")
            pairs = stored(few, "entity-terms")
    together = pairs.join(counted, "term")
    share = F.log(_sure_part(F.col("n_te"), F.col("n_t"), confidence) * rarity) / F.log(rarity)
    found = together.select("term", share.alias("share")).where(F.col("share") >= discloses)
    return stored(found.groupBy("term").agg(F.max("share").alias("share")), "disclosing-terms")


def corpus_counts(docs: DataFrame, text_col: str, wanted: DataFrame, bitmap: Bitmap, part: int = 1) -> DataFrame:
    """``term, n_t``: the different lines of all texts that hold each wanted term.

    With ``part``, only of the lines whose hash is a multiple of it.
    """
    lines = contexts(docs, text_col)
    if part > 1:
        lines = lines.where(F.pmod(F.xxhash64("line"), F.lit(part)) == 0)
    passed = F.filter(terms_of(F.col("line")), lambda t: bitmap.may_hold(F.xxhash64(t)))
    rows = lines.select(F.xxhash64("line").alias("id"), F.explode(passed).alias("term")).distinct()
    return rows.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def _with_terms(rows: DataFrame, terms: DataFrame | None) -> DataFrame:
    """``rows(id, text)`` with the disclosing ``terms`` that each text holds; null if none."""
    none = F.lit(None).cast("array<string>").alias("terms")
    bitmap = None if terms is None else bitmap_of(terms.select(F.xxhash64("term").alias("h")), "h")
    if bitmap is None:
        return rows.withColumn("terms", none)
    passed = F.filter(terms_of(F.col("text")), lambda t: bitmap.may_hold(F.xxhash64(t)))
    held = rows.select(F.col("id").alias("key"), F.xxhash64("text").alias("hash"), F.explode(passed).alias("term"))
    held = held.join(terms.select("term"), "term").groupBy("key", "hash").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    same = F.col("id").eqNullSafe(F.col("key")) & (F.xxhash64("text") == F.col("hash"))
    return rows.join(held, same, "left").drop("key", "hash")


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    discloses: float = DISCLOSES,
    confidence: float = CONFIDENCE,
    carry: bool = False,
) -> DataFrame:
    """``id, base, spans`` and, with ``carry``, ``row`` (all columns as a struct) for every row.

    ``base`` are the spans of emails, IPs, cards and phone numbers; ``spans`` also those of terms that
    disclose them, wherever they occur. A span is ``start, rank, kind, end, hit`` in code points, end
    exclusive, ordered by start and then kind. Null texts count as empty ones and have none. Ids may
    be null or repeat. An empty table gives no rows.
    """
    terms = disclosing_terms(docs, text_col, discloses, confidence)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = _with_terms(docs.select(F.col(id_col).alias("id"), text.alias("text"), *row), terms)
    rows = rows.withColumn("base", base_spans(F.col("text")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    own = _named(matches(F.col("text"), pattern), TERM)
    spans = F.when(F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0, F.array_sort(F.concat("base", own))).otherwise(F.col("base"))
    return rows.select("id", "text", *["row"] * carry, "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans as text."""
    kinds = F.transform("base", lambda m: m["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def rewritten(text: Column, spans: Column, general: dict[str, str] = GENERAL) -> Column:
    """The text with every span replaced by its general word; of spans that overlap the first stands."""
    words = F.create_map(*[F.lit(x) for pair in general.items() for x in pair])

    def step(done: Column, m: Column) -> Column:
        fits = m["start"] >= done["at"]
        gap = F.substring(text, done["at"] + 1, m["start"] - done["at"])
        out = F.when(fits, F.concat(done["out"], gap, words[m["kind"]])).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], m["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all personal data and disclosing terms of the text replaced; other columns stay.

    The words that stand for a kind are ``GENERAL``; an empty one removes the span. A null text stays
    null. Columns of any name are carried along.
    """
    found = find(docs, id_col, text_col, carry=True, **how)
    clean = F.when(F.size("spans") > 0, rewritten(F.col("text"), F.col("spans"))).otherwise(F.col(f"row.`{text_col}`"))
    columns = [clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)
