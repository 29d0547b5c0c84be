"""DuckDB SQL with the results of those corpus queries that SQL can express."""

from __future__ import annotations

from sediment.llm.license_scan import RULES, SENTENCES, WORD


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(licence: str, how: str, wanted: tuple[str, ...]) -> str:
    between = "," if how == "next" else ",(?:.*,)?"
    pattern = "," + between.join(w.replace(".", r"\.").replace("-", r"\-") for w in wanted) + ","
    return f"CASE WHEN regexp_matches(line, {_quoted(pattern)}) THEN {_quoted(licence)} END"


_KNOWN = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in SENTENCES.items())
_LONGEST = max(len(s.split()) for s in SENTENCES)
_RULES = ", ".join(_rule(*r) for r in RULES)

ORACLES: dict[str, str] = {
    "op6_url_filter": r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parsed AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
pairs AS (SELECT DISTINCT host, path FROM parts),
hits AS (SELECT host, path, rule_host || rule_path AS rule, verdict,
  row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM pairs JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.host = h.host AND p.path = h.path AND h.n = 1""",
    # RE2 has no look-ahead: a mark for the end of a sentence is put in first, then the text is cut there.
    "op7_license_scan": rf"""
WITH RECURSIVE known(sentence, ident) AS (VALUES {_KNOWN}),
texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, replace(coalesce(text, ''), chr(1), ' ') AS t FROM documents),
cuts AS (SELECT r, string_split(regexp_replace(regexp_replace(t, '[.!?;]+([ \t\n\x0B\f\r])', chr(1) || '\1', 'g'), '\n[ \t\x0B\f\r]*\n', chr(1), 'g'), chr(1)) AS cut FROM texts),
parts AS (SELECT r, unnest(cut) AS s, unnest(range(len(cut))) AS part FROM cuts),
lines AS (SELECT r, part, list_filter(list_transform(string_split(s, chr(10)),
  lambda l: lower(array_to_string(regexp_extract_all(l, '{WORD}'), ' '))), lambda l: l <> '') AS l FROM parts),
starts AS (SELECT r, part, l, unnest(range(len(l))) AS line FROM lines),
runs AS (SELECT r, part, line, array_to_string(list_slice(l, line + 1, line + {_LONGEST}), chr(10)) AS rest FROM starts
  WHERE split_part(l[line + 1], ' ', 1) IN (SELECT split_part(sentence, ' ', 1) FROM known)),
hits AS (SELECT r, part, line, length(sentence) AS n, ident, line + len(string_split(substr(rest, 1, length(sentence)), chr(10))) AS nxt
  FROM runs JOIN known ON split_part(replace(rest, chr(10), ' '), ' ', 1) = split_part(sentence, ' ', 1)
    AND starts_with(replace(rest, chr(10), ' ') || ' ', sentence || ' ') AND substr(rest || chr(10), length(sentence) + 1, 1) = chr(10)),
best AS MATERIALIZED (SELECT r, part, line, max_by(nxt, n) AS nxt, max_by(ident, n) AS ident FROM hits GROUP BY r, part, line),
steps AS MATERIALIZED (SELECT b.r, b.part, b.line, b.ident, min(c.line) AS succ
  FROM best b LEFT JOIN best c ON b.r = c.r AND b.part = c.part AND c.line >= b.nxt GROUP BY b.r, b.part, b.line, b.ident),
walk AS (SELECT r, part, line, ident, succ FROM steps WHERE (r, part, line) IN (SELECT (r, part, min(line)) FROM best GROUP BY r, part)
  UNION ALL SELECT s.r, s.part, s.line, s.ident, s.succ FROM walk w JOIN steps s ON s.r = w.r AND s.part = w.part AND s.line = w.succ),
ids AS (SELECT r, string_agg(ident, ',' ORDER BY part, line) AS sentences FROM walk GROUP BY r),
marked AS (SELECT t.doc_id, coalesce(i.sentences, '') AS sentences, ',' || coalesce(i.sentences, '') || ',' AS line FROM texts t LEFT JOIN ids i USING (r)),
found AS (SELECT doc_id, sentences, list_filter([{_RULES}], lambda x: x IS NOT NULL) AS l FROM marked),
firsts AS (SELECT doc_id, sentences, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM found)
SELECT doc_id, sentences, array_to_string(l, ',') AS licenses,
  CASE WHEN len(l) > 0 THEN l[1] WHEN sentences <> '' THEN 'unknown' ELSE 'none' END AS license FROM firsts""",
}
