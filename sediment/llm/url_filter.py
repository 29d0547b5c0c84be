"""URL rules looked up by host suffixes and path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import ascii_lower, free_name

#: Rules and distinct rule lengths up to which the rules are sent to every task.
BROADCAST_RULES = 200_000
#: Hexadecimal digits of the short hash that is joined on; the full digest is compared afterwards.
SHORT = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.when(_has_host(url), ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.when(_has_host(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _has_host(url: Column) -> Column:
    return F.coalesce(F.locate("://", url), F.lit(0)) > 0


def _rest(url: Column) -> Column:
    return F.substr(url, F.locate("://", url) + 3)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _expressions(labels: list[int], lengths: list[int]) -> Column:
    """Digests of the pairs of a host suffix and a path prefix that a rule could have."""
    names = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= F.size(names)),
        lambda n: F.array_join(F.slice(names, F.size(names) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row per host and path of ``rules(host, path, verdict)``; block wins over allow."""
    clean = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    clean = clean.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    clean = clean.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return clean.select("*", digest.alias("rule_digest"), F.substring(digest, 1, SHORT).alias("short"))


def verdicts(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` for those distinct ``host, path`` that a rule fits."""
    clean = prepare_rules(rules)
    labels, lengths, n = clean.agg(
        # a host has few labels and a path few lengths, so these lists stay short for any number of rules
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))),
        F.sort_array(F.collect_set(F.length("rule_path"))),
        F.count(F.lit(1)),
    ).first()
    if not n:
        return pairs.select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).where("false")
    asked = pairs.select("host", "path", F.explode(_expressions(labels, lengths)).alias("digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, SHORT))
    found = asked.join(F.broadcast(clean) if n <= BROADCAST_RULES else clean, "short")
    found = found.where("digest = rule_digest")
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"))
    best = found.groupBy("host", "path").agg(F.max(F.struct(order.alias("o"), "verdict")).alias("best"))
    return best.select("host", "path", F.col("best.o.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def filter_urls(rows: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``rows`` with ``host``, ``path``, ``rule`` and ``verdict`` of each URL.

    A rule of ``rules(host, path, verdict)`` fits its host and all subdomains if the URL's path
    starts with its path. Of the rules that fit, the longest (host and path together) decides;
    without one, ``rule`` is null and the verdict is ``otherwise``. A null URL or one without
    ``://`` has an empty host and path, which no rule with a host fits. Each different pair of host
    and path is judged once, so repeated URLs cost one look-up. Columns of these names in ``rows``
    are replaced; others stay. No rules: every verdict is ``otherwise``.
    """
    out = ["host", "path", "rule", "verdict"]
    keys = [free_name(rows, "_url_host"), free_name(rows, "_url_path")]
    url = F.col(url_col)
    parsed = rows.withColumn(keys[0], host_of(url)).withColumn(keys[1], path_of(url))
    pairs = parsed.select(F.col(keys[0]).alias("host"), F.col(keys[1]).alias("path")).distinct()
    known = verdicts(pairs, rules).select(
        *[F.col(a).alias(b) for a, b in zip(["host", "path"], keys, strict=True)],
        *[F.col(c).alias(f"{keys[0]}_{c}") for c in ("rule", "verdict")],
    )
    joined = parsed.join(known, keys, "left")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in out]
    verdict = F.coalesce(F.col(f"{keys[0]}_verdict"), F.lit(otherwise)).alias("verdict")
    named = [F.col(k).alias(n) for k, n in zip(keys, out, strict=False)]
    return joined.select(*kept, *named, F.col(f"{keys[0]}_rule").alias("rule"), verdict)
