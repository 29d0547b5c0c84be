"""The pipeline against its stages in plain Python."""

import corpus_pipeline
from helpers import empty_docs, odd_docs
from test_pairs import brute_leaks, similar_components
from test_rows import simple_base, simple_private

import __spark_entry__ as entry
from sediment.llm import packing, quality_rules
from sediment.llm.common import table

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_what_plain_python_keeps(spark):
    docs = table(spark, SMALL, "documents").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality_rules", "simhash_dups", "decontaminate", "sanitise", "packing"]
    good = stages["quality_rules"](spark, docs, SMALL).cache()
    ids = {r.doc_id for r in good.collect()}
    for r in docs.collect():
        n, *_, repeated = simple_base(r.text)
        assert not (r.doc_id in ids and (n < 50 or 2 * repeated > n))
    model = quality_rules.learn(docs, table(spark, SMALL, "labels"))
    assert ids == {r.id for r in quality_rules.judge(docs, model).where("kept").collect()}

    unique = stages["simhash_dups"](spark, good, SMALL).cache()
    root = similar_components({r.doc_id: r.text for r in good.collect()})
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(root.values()))

    clean = stages["decontaminate"](spark, unique, SMALL).cache()
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in unique.collect()}
    leaked = {d for d, _ in brute_leaks(texts.items(), items)}
    assert {r.doc_id for r in clean.collect()} == set(texts) - leaked

    hidden = stages["sanitise"](spark, clean, SMALL).cache()
    assert hidden.columns == docs.columns and hidden.count() == clean.count()
    assert all(simple_private(r.text) == "" for r in hidden.collect())

    pieces = stages["packing"](spark, hidden, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in hidden.collect()}
    assert pieces.count() == packing.pack(hidden, ids=False).count() == entry.queries()["pipeline"](spark, SMALL).count()


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).where("length < 1").count() == 0
