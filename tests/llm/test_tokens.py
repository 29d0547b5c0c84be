"""Packing and token files against plain encoding of whole texts."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import empty_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sediment.llm import packing, token_files, tokens
from sediment.llm.tokens import Encoder, default_tokenizer

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


PARTS = ["a", "B", "word", "Word,", "don't", "'S", "É", "é", "J̌", " ", "\x85", "12", "٣", "½", "ª", "ß", "İ", "K", "<|endoftext|>", "<|ENDOFTEXT|>", "!", "...", "中文", "😀", "_", "\x1c", "\x00", "ﬁ", "a|", "x.", "co,op", "\t", "\n", " ", "re", "'re", "’s"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=14).map("".join))
def test_words_encode_like_whole_texts(text):
    plain = Tokenizer.from_file(default_tokenizer())
    text = text.encode("utf-8", "ignore").decode()
    assert Encoder(default_tokenizer(), 9).encode([text.encode()])[0].tolist() == ids_of(plain, text) + [9]


def check_pieces(pieces, expected):
    """Every id in one piece; sequences without gaps, all but the last full."""
    ends, seen = {}, {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset and r.length > 0
        ends[r.sequence_id] = r.offset + r.length
        options = [e for e in expected if e[0] == r.id and len(e[1]) == r.doc_tokens]
        own = [zlib.crc32(np.array(e[1][r.start : r.start + r.length], "<u4").tobytes()) for e in options]
        assert r.ids_crc32 in own
        seen[r.id] = seen.get(r.id, 0) + r.length
    assert sorted(ends) == list(range(len(ends))) and all(v == 2048 for k, v in ends.items() if k < len(ends) - 1)
    total = {}
    for i, ids in expected:
        total[i] = total.get(i, 0) + len(ids)
    assert seen == total


def test_packing_of_a_corpus_and_of_odd_rows(spark, plain):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5), odd_docs(spark)):
        expected = [(r.doc_id, ids_of(plain, r.text) + [1]) for r in docs.select("doc_id", "text").collect()]
        check_pieces(packing.pack(docs, ids=False).collect(), expected)
    assert packing.pack(empty_docs(spark)).collect() == []


def test_sequences_are_padded_unless_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "a " * 3000), (2, "b " * 2000), (3, None)], "doc_id long, text string")
    rows = packing.sequences(packing.pack(docs)).orderBy("sequence_id").collect()
    assert [len(r.tokens) for r in rows] == [2048] * 3
    assert rows[2].tokens[-1] == 0 and sum(b.length for r in rows for b in r.boundaries) == 5003
    few = packing.sequences(packing.pack(docs.where("doc_id = 3").union(docs.where("doc_id = 3")))).first()
    assert few.tokens == [1, 1]


def test_files_hold_all_ids_in_order(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").repartition(7)
    expected, at = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = ids_of(plain, r.text) + [2]
        expected[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = token_files.checksums(token_files.round_trip(docs)).collect()
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected


def test_files_of_odd_rows(spark):
    got = token_files.round_trip(odd_docs(spark)).orderBy("start").collect()
    ids = [r.id for r in got]
    assert ids == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8] and got[1].tokens == [2]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(10)]
    assert token_files.round_trip(empty_docs(spark)).collect() == []


def test_file_layout_and_selective_reads(spark, folder):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma"], k=50))) for k in range(400)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), folder, row_group=64 << 10)
    import glob

    seen = set()
    for file in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                seen.add((column.path_in_schema.split(".")[0], tuple(sorted(column.encodings)), column.has_column_index))
    assert all(index for _, _, index in seen)
    assert any(name == "tokens" and any("DICTIONARY" in e for e in kinds) for name, kinds, _ in seen)
    assert any(name == "before" and "DELTA_BINARY_PACKED" in kinds for name, kinds, _ in seen)
    plan = token_files.read(spark, folder, tokens=False).where("id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan and "tokens:array" not in plan


def test_packing_stores_ids_as_bytes(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string")
    found = packing.tokenised(rows, "doc_id", "text", packing.END, as_bytes=True).collect()
    assert all(isinstance(r.tokens, (bytes, bytearray)) and len(r.tokens) == 4 * r.n_tokens for r in found)
    assert all(int.from_bytes(r.tokens[-4:], "little") == packing.END for r in found)


def test_words_of_letters_go_to_the_model(monkeypatch):
    words = tokens.Words(tokens.default_tokenizer())
    assert words.straight
    monkeypatch.setattr(words, "_encode", None)
    texts = [b"Hello", b"hello,", b"s", b"re", b"ll", b"Q", b"iNTERNATIONALISATION", b"zzzqqqxxw!", b"a" * 3000, *(w.encode() for w in ("ÀÉÎõü", "straße.", "ÿþÞ", "Œuvre"[1:] + "é,", "çÇ|", "é"))]
    for text in texts:
        words[text]
    monkeypatch.setattr(words, "_joined", lambda *found: [])
    monkeypatch.setattr(words, "_encode", lambda found: [] if not found else 1 / 0)  # for other words only
    words.learn()
    for text in texts:
        k = words[text]
        got = words.flat[words.starts[k] : words.starts[k] + words.sizes[k]].tolist()
        assert got == words.tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_letters_that_are_changed_before_the_model_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, normalizers

    changed = Tokenizer.from_file(tokens.default_tokenizer())
    changed.normalizer = normalizers.Sequence([normalizers.Lowercase(), normalizers.Replace("qu", "kw")])
    changed.save(str(tmp_path / "changed.json"))
    words = tokens.Words(str(tmp_path / "changed.json"))
    assert not words.straight
