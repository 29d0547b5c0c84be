"""Rules, languages, quality, URLs, licences and personal data."""

import collections
import hashlib
import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import CLASHING, empty_docs, odd_docs, words

import __spark_entry__ as entry
from sediment.llm import language_id, license_scan, quality_model, quality_rules, queries, sanitise, url_filter
from sediment.llm.common import fold_number
from sediment.llm.oracle_sql import ORACLES

SMALL = "/root/testdata/sf0.001"
NATIVE = ["op1_benchmark_leaks", "op6_url_filter", "op7_license_scan", "op9_private_data"]


def labels_of(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/labels.parquet")


def simple_base(text):
    own = words(text)
    grams = list(zip(own, own[1:], own[2:], strict=False))
    often, marked, lines = collections.Counter(grams), set(), collections.Counter()
    for i, g in enumerate(grams):
        if often[g] > 1:
            marked |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words(line):
            lines[line] += 1
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(own), sum(map(len, own)), symbols, sum(n - 1 for n in lines.values()), len(marked)


def test_base_counts_equal_plain_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = random.Random(6)
    rows += [(10_000 + k, "".join(rng.choices(["a ", "b ", "a b ", "\n", "é", "#", "\x0b", "\x1c", "c|"], k=30))) for k in range(200)]
    none = quality_rules.Model(np.zeros(64), quality_rules.Strata(np.full(64, -1), np.ones(1)), np.zeros(1))
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), none)
    for r in found.collect():
        counts = simple_base(dict(rows)[r.id])
        assert counts == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and r.kept == (not r.base_failed)


def test_scores_are_mean_log_ratios_and_junk_goes(spark):
    rng = random.Random(7)
    clean = [" ".join(rng.choices(["the", "of", "and", "river", "stone", "light", "walks"], k=80)) for _ in range(300)]
    junk = [" ".join(rng.choices(["buy$$", "now&&", "cheap%%", "click##"], k=80)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    sides = []
    for texts in (clean[::2], clean, junk):
        sides.append(collections.Counter())
        for text in texts:
            own = words(text)
            sides[-1].update(own)
            sides[-1].update(zip(own, own[1:], strict=False))
    seen, good, bad = sides
    # Clean texts weigh as their share of the trusted text, which they are alone in, is to that of the raw text.
    weight = 1 / (good.total() / (good.total() + bad.total()))
    scale, smoothing = seen.total() / (weight * good.total() + bad.total()), 2 * seen.total() / 65_536
    model = quality_rules.learn(docs, labels)
    found = {r.id: r for r in quality_rules.judge(docs, model).collect()}
    for k in range(500):
        own = words((clean + junk)[k])
        grams = own + list(zip(own, own[1:], strict=False))
        score = np.mean([np.log((seen[g] + smoothing) / ((weight * good[g] + bad[g]) * scale + smoothing)) for g in grams])
        assert found[k].score == pytest.approx(score, abs=1e-6)
    assert all(found[k].kept == (found[k].score >= model.thresholds.min() and not found[k].base_failed) for k in range(500))
    plain = {k for k, t in enumerate(clean) if 100 * simple_base(t)[4] <= 50 * 80}
    lost = plain - {k for k, r in found.items() if r.kept}
    assert {k for k, r in found.items() if r.kept} <= plain and len(lost) <= 0.03 * len(plain)
    plain -= lost
    kept = quality_rules.keep_good(docs.selectExpr("*", "1 AS kept", "2 AS text2"), labels)
    assert {r.doc_id for r in kept.collect()} == plain and kept.columns[-1] == "text2"


def kept_of(spark, docs, labels):
    return {r.id for r in quality_rules.judge(docs, quality_rules.learn(docs, labels)).where("kept").collect()}


def test_thinned_labels_and_hot_copies_change_no_verdicts(spark):
    """Half of one language's labels gone, and a clean text copied until it is a third of all rows."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").drop("source").cache(), labels_of(spark, folder)
    german = docs.where("lang = 'de'").select("doc_id")
    marked = {r.doc_id: r.quality for r in labels.join(german, "doc_id").collect()}
    passed = {r.id for r in quality_rules.judge(docs.join(german, "doc_id", "left_semi"), quality_rules.learn(docs, labels)).where("NOT base_failed").collect()}
    good, bad = ({d for d, q in marked.items() if q == k and d in passed} for k in (1, 0))
    thin = labels.join(german.where("doc_id % 2 = 0"), "doc_id", "left_anti")
    kept = kept_of(spark, docs, thin)
    assert len(good & kept) >= 0.95 * len(good) > 300 and len(bad & kept) <= 0.05 * len(bad)
    one = docs.join(labels, "doc_id", "left_anti").where("lang = 'en' AND n_chars BETWEEN 800 AND 1500").orderBy("doc_id").limit(1)
    copies = one.withColumn("doc_id", F.explode(F.sequence(F.lit(10**7), F.lit(10**7 + 4999)))).select(docs.columns)
    kept = kept_of(spark, docs.unionByName(copies), labels)
    assert len([d for d in kept if d >= 10**7]) == 5000 and len(good & kept) >= 0.95 * len(good)


def test_strata_are_groups_of_near_words():
    near = np.array([[1, 0.9, 0.1, 0], [0.9, 1, 0.6, 0], [0.1, 0.6, 1, 0.5], [0, 0, 0.5, 1]])
    assert quality_rules.grouped(near, 0.4) == [[0, 1], [2, 3]]  # 1 and 2 are near, their groups are not
    assert quality_rules.grouped(np.zeros((0, 0)), 0.4) == []


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    held = [r for r in docs.collect() if fold_number(r.doc_id) == 2]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_spans_of_mixed_text_and_scripts(spark):
    rng = random.Random(8)
    english, russian = ["river", "stone", "walking", "under", "the"], ["река", "камень", "идёт", "под", "этот"]
    german = ["schöner", "wälder", "gehen", "unter", "dieser"]
    made = {"en": english, "ru": russian, "de": german}
    rows = [(k, " ".join(rng.choices(made[lang], k=30)), lang) for k, lang in enumerate(["en", "ru", "de"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.languages == ["de", "en", "ru"]
    mixed = " ".join(english * 4 + ["17", "--"] + german * 3 + russian * 2)
    r = language_id.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [(s.first, s.last, s.lang) for s in r.spans] == [(0, 19, "en"), (20, 34, "de"), (35, 44, "ru")]
    assert (r.lang_pred, r.score) == ("en", pytest.approx(20 / 45))


def test_best_paths_equal_a_plain_viterbi():
    rng = np.random.default_rng(9)
    sizes = [0, 1, 7, 3, 20, 7]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(0, 3, (ends[-1], 3)).astype(np.float32)
    path = language_id.best_paths(scores, ends, 4.0)
    for block in (1, 2, 4):  # long texts are cut into blocks
        assert (language_id.best_paths(scores, ends, 4.0, block) == path).all()

    def worth(labels, own):
        return sum(own[t, lang] for t, lang in enumerate(labels)) - 4.0 * sum(a != b for a, b in zip(labels, labels[1:], strict=False))

    for a, b in zip(ends, ends[1:], strict=False):
        own, best = scores[a:b].astype(float), {(): 0.0}
        if a == b:
            continue
        best = {(k,): own[0, k] for k in range(3)}
        for t in range(1, b - a):
            step = {}
            for labels, value in best.items():
                for k in range(3):
                    new = value - 4.0 * (labels[-1] != k) + own[t, k]
                    if new > step.get(k, ((), -1e9))[1]:
                        step[k] = (labels + (k,), new)
            best = dict(step.values())
        assert worth(list(path[a:b]), own) == pytest.approx(max(best.values()))


def test_three_hundred_languages():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(5000, 300)).astype(np.float32)
    scores[:, 280] += 9
    for block in (4096, 512):
        assert (language_id.best_paths(scores, np.array([0, 5000]), 12.0, block) == 280).all()


def test_long_texts_in_blocks_have_the_same_path():
    rng = np.random.default_rng(5)
    true = np.repeat(rng.integers(0, 4, 120), 250)
    scores = rng.normal(0, 2, (len(true), 4)).astype(np.float32)
    scores[np.arange(len(true)), true] += 3
    ends = np.array([0, 100, len(true)])
    whole = language_id.best_paths(scores, ends, 12.0, 1 << 20)
    assert (language_id.best_paths(scores, ends, 12.0, 1000) == whole).all() and (whole == true).mean() > 0.98


def test_quality_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), labels_of(spark, folder)
    found = {r.id: r for r in quality_model.classify(docs, quality_model.learn(docs, labels)).collect()}
    held = [r for r in labels.collect() if fold_number(r.doc_id) == 2]
    assert sum(found[r.doc_id].predicted == r.quality for r in held) >= 0.95 * len(held)


def test_pair_terms_cost_linear_time_and_are_right():
    rng = np.random.default_rng(10)
    size = quality_model.BUCKETS + 2
    model = quality_model.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 8)), np.zeros(2), np.ones(2))
    index, values, dense = np.array([3, 70, 900]), np.array([0.2, 0.5, 0.1]), np.array([[0.4, -1.0]])
    got = quality_model.scores(model, [index], [values], dense)[0]
    at, x = np.concatenate([index, [size - 2, size - 1]]), np.concatenate([values, dense[0]])
    raw = 0.3 + model.weights[at] @ x
    raw += sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(5) for j in range(i + 1, 5))
    assert got == pytest.approx(1 / (1 + np.exp(-raw)))


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def simple_private(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


BITS = ["a@b.co", "@", ".", "-", "+1 ", "(555) ", "1", "4539578763621486", "1.2.3.4", "256", "x", "é", "😀", " ", "\n", "_", "%", "0", "12", "+", "a.b", "@c.d", "999.1.1.1", "4111 1111 1111 1111", "+44 20 7946 0958", ")", ".."]


def test_private_data_equals_plain_python(spark):
    rng = random.Random(11)
    rows = [(k, "".join(rng.choices(BITS, k=rng.randint(0, 14)))) for k in range(1500)] + [(2000, None), (2001, ""), (2002, "9" * 100_000 + "@")]
    found = sanitise.digest(sanitise.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    for r in found:
        own = simple_private(dict(rows)[r.id])
        assert r.base_sha256 == hashlib.sha256(own.encode()).hexdigest() and r.n_ip == own.count("ip:")
        assert [s for s in r.spans.split(",") if not s.startswith("term")] == own.split(",")


def test_terms_that_reveal_an_address_are_hidden_everywhere(spark):
    rows = [(k, f"call Xaveria at xav@mail.com about item{chr(97 + k) * 3}") for k in range(8)]
    rows += [(100 + k, f"the line about call at nothing {chr(97 + k % 26) * 5}{k}") for k in range(300)]
    rows += [(500, "XAVERIA wrote; xaverias did not"), (501, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'v' AS {c}" for c in CLASHING])
    clean = sanitise.sanitise(docs)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and texts[101] == rows[9][1]
    assert texts[0] == texts[501] == "call [TERM] at [EMAIL] about itemaaa"
    assert texts[500] == "[TERM] wrote; xaverias did not"
    shares = {r.term: r.share for r in sanitise.disclosing_terms(docs).collect()}
    assert set(shares) == {"xaveria"}
    assert shares["xaveria"] == pytest.approx(simple_shares([r[1] for r in rows])["xaveria"])


def simple_shares(texts, z=sanitise.CONFIDENCE, size=sanitise.CONTEXT):
    """Shares of all terms, counted one by one."""
    lines = {line for t in texts if t for line in t.split("\n")}
    pieces = {p for line in lines for p in ([line] if len(line) <= size else re.findall(rf"(?s).{{1,{size}}}(?=\s|\Z)|.{{1,{size}}}", line))}
    total = sum(bool(re.search(r"[^\W\d_]", p)) for p in pieces)
    n_t, n_e, n_te = (collections.Counter() for _ in range(3))
    for piece in pieces:
        terms, rest, own = {t for t in re.split(r"[\W\d_]+", piece.lower()) if t}, piece, set()
        for kind, p in PATTERNS:
            hits = [m.group() for m in re.finditer(p, piece) if valid(kind, m.group())]
            own |= {(kind, h.lower() if kind == "email" else h if kind == "ip" else re.sub("[^0-9]", "", h)) for h in hits}
            rest = re.sub(p, " ", rest)
        n_t.update(terms)
        n_e.update(own)
        n_te.update((e, t) for e in own for t in {t for t in re.split(r"[\W\d_]+", rest.lower()) if t})
    shares = {}
    for (e, t), k in n_te.items():
        n, p = n_t[t], k / n_t[t]
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if n_e[e] < total:
            shares[t] = max(shares.get(t, -9), np.log(low * total / n_e[e]) / np.log(total / n_e[e]))
    return shares


def test_rare_names_are_found_and_common_words_stay(spark):
    rng = random.Random(5)
    common = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ran", "sel", "tim", "vod", "wix", "yor")]
    names = [f"{a}{b}{c}" for a in ("zor", "qui", "xan") for b in "aeiouy" for c in ("ph", "lk", "rt", "mb", "gg")] + ["li", "李明", "q"]
    rows = [" ".join(rng.choices(common, k=12)) for _ in range(6000)]
    planted = {}
    for k, name in enumerate(names):
        together, apart = 1 + k % 3, k % 4 // 3
        planted[name] = (together, apart)
        rows += [f"{rng.choice(common)} {name} {rng.choice(common)} {k}.{name if name.isascii() else 'm'}@mail{k}.org {' '.join(rng.choices(common, k=8))}" for _ in range(together)]
        rows += [f"{' '.join(rng.choices(common, k=9))} {name.upper()}" for _ in range(apart)]
    rows += [rows[-1]] * 2000  # copies of a line change no count
    rows += [" ".join(rng.choices(common, k=900)) + " 10.0.0.7 zelig " + " ".join(rng.choices(common, k=900))] * 2 + ["x" * 4500 + " 10.9.9.9"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)] + [(-1, None), (-2, "")], "doc_id long, text string")
    want = {t: v for t, v in simple_shares(rows).items() if v >= sanitise.DISCLOSES}
    got = {r.term: r.share for r in sanitise.disclosing_terms(docs).collect()}
    assert got == pytest.approx(want) and "zelig" in got
    assert not set(common) & set(got)
    once_only = [n for n, (_, apart) in planted.items() if not apart]
    assert len(once_only) > 60 and set(once_only) <= set(got)
    assert len(set(planted) & set(got)) >= 0.9 * len(planted)
    texts = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert all(texts[k] == rows[k] for k in range(6000))


def test_licences_in_sentences(spark):
    notice = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
    rows = [
        (1, "Text.\n\nReleased under the MIT License.\nMore."),
        (2, "  * LICENSED under the  Apache License, Version 2.0."),
        (3, "This is not released under the MIT License, or is it?"),
        (4, "This work is licensed under the GNU General Public License, version 3. Either version 3 of the License, or (at your option) any later version."),
        (5, "You may not use this file except in compliance with the License."),
        (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (7, notice),
    ]
    found = {r.id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k].license for k in range(1, 7)] == ["MIT", "Apache-2.0", "none", "GPL-3.0-or-later", "unknown", "MIT"]
    assert found[6].licenses == "MIT,CC-BY-NC-4.0" and found[4].sentences == "gpl-3-notice,gpl-3-later"


NOTICES = {
    "MIT": '''Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT''',
    "Apache-2.0": '''Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law''',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
}


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ENDORSE = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
DISCLAIM = '''
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT'''
NOTICES |= {
    "BSD-2-Clause": BSD + DISCLAIM,
    "BSD-3-Clause": BSD + ENDORSE + DISCLAIM,
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "SPDX-License-Identifier: Zlib",
}


def planted_notices():
    rows = []
    for name, text in NOTICES.items():
        for width in (30, 60, 77):
            wrapped = "\n\n".join(textwrap.fill(p.strip(), width) for p in text.split("\n\n"))
            comment = "/*\n" + "\n".join(" * " + line for line in wrapped.split("\n"))
            rows += [(name, text), (name, wrapped), (name, "Copyright 2020 Somebody\n" + wrapped), (name, comment)]
    return rows + [("MIT", "Licensed under the MIT License\nand a line more"), ("none", "Licensed under\n\nthe MIT License"), (None, None), ("none", "")]


def test_licences_in_real_notices_wrapped_and_not(spark):
    rows = planted_notices()
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.id, r.license) for r in found if r.id != r.license and r.id] == [] and len(found) == len(rows)


def test_licence_sql_cuts_wrapped_notices_alike(spark):
    rows = planted_notices()
    rows += [("mixed", "\n".join(t for _, t in rows[k : k + 5] if t)) for k in range(0, len(rows), 3)]
    rows += [("marks", "a.. ; \x0b? Licensed under the MIT License.\n \nAll\n\n--\nrights.\nAll\n*\nrights reserved"), ("words", "x.-y a--b SPDX-License-Identifier: MIT\nSPDX-License-Identifier:\nMIT")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = db.execute(f"SELECT doc_id, sentences, licenses, license FROM ({ORACLES['op7_license_scan']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in license_scan.scan(docs).collect())


def test_licence_tables_of_any_size(spark, monkeypatch):
    many = {f"word{k} second third{k % 7}": f"id-{k}" for k in range(3000)} | {"alone": "single", "alone again": "double"}
    rules = spark.createDataFrame([(0, "Both", "later", ["id-7", "double"]), (1, "One", "next", ["single"]), (2, None, "next", ["single"])], "rank int, license string, how string, wanted array<string>")
    docs = spark.createDataFrame([(1, "Word7, second\nthird0. Alone\nagain"), (2, "alone"), (2, "alone"), (3, "alone\nalone again?"), (None, "word8 second third1")], "doc_id int, text string")
    want = [("1", "id-7,double", "Both"), ("2", "single", "One"), ("2", "single", "One"), ("3", "single,double", "One"), ("None", "id-8", "unknown")]
    for size in (license_scan.BROADCAST_BYTES, 10):
        monkeypatch.setattr(license_scan, "BROADCAST_BYTES", size)
        found = license_scan.scan(docs, sentences=license_scan.sentence_table(spark, many), rules=rules).collect()
        assert sorted((str(r.id), r.sentences, r.license) for r in found) == want
    none = license_scan.scan(docs, sentences=license_scan.sentence_table(spark).where("false")).collect()
    assert [r.license for r in none] == ["none"] * 5


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://COM", "http://com/", "https://a.b.Com/x?y=http://net/es/", "ftp://net/es/1#f", "http://xnet/es/", "http://net?/es/", "://www.example.com/en/1", "http://example.com/en", "http://m.example.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS verdict", "1 AS short", "2 AS Host")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    none = ("", "", None, "allow")
    assert got == {
        0: none, 1: none, 2: none, 3: ("com", "", None, "allow"), 4: ("com", "/", "com/", "allow"), 5: ("a.b.com", "/x", "com/", "allow"),
        6: ("net", "/es/1", "net/es/", "block"), 7: ("xnet", "/es/", None, "allow"), 8: ("net", "", None, "allow"),
        9: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 10: ("example.com", "/en", "com/", "allow"),
        11: ("m.example.com", "/en/", "example.com/en/", "block"),
    }
    assert url_filter.filter_urls(pages, rules.where("false"), otherwise="block").where("verdict = 'block'").count() == 12
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0


def test_odd_rows_have_results(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, None), (8, None, None)], "doc_id long, quality int, toxic int")
    languages = {r.id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert [languages[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and len(languages[7].spans) == 1
    assert quality_model.classify(docs, quality_model.learn(docs, labels)).where("score BETWEEN 0 AND 1").count() == 10
    judged = quality_rules.judge(docs, quality_rules.learn(docs, labels))
    assert judged.count() == 10 and judged.where("kept").count() == 0
    assert license_scan.scan(docs).where("license = 'none'").count() == 10
    assert sanitise.sanitise(docs).exceptAll(docs).count() == 0
    assert sanitise.digest(sanitise.find(docs)).where("spans = ''").count() == 10


def test_empty_tables(spark):
    docs, labels = empty_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language_id.identify(docs, language_id.learn(docs)).count() == 0
    assert language_id.identify(odd_docs(spark), language_id.learn(docs)).where("lang_pred = 'und'").count() == 10
    assert quality_model.classify(odd_docs(spark), quality_model.learn(docs, labels)).where("score = 0.5").count() == 10
    assert quality_rules.keep_good(docs, labels).count() == 0
    assert license_scan.scan(docs).count() == 0
    assert sanitise.sanitise(docs).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    frame, result = entry.queries()[name](spark, SMALL), db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    rows = [tuple(map(repr, r)) for r in result.fetchall()]
    assert sorted(tuple(map(repr, r)) for r in frame.select(*columns).collect()) == sorted(rows)


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python_and_no_cross_product(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
