"""Near-duplicates and benchmark passages against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from helpers import empty_docs, lowered, odd_docs, shingles, weighted, words

from sediment.llm import decontaminate, similar_dups, simhash_dups
from sediment.llm.links import components, local_roots

SMALL = "/root/testdata/sf0.001"


def simple_fingerprint(text):
    own = words(lowered(text))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles(own, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simple_components(prints, radius):
    names = sorted(prints)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(150)
    docs = docs.unionByName(odd_docs(spark, clash=False).where("doc_id <> 7").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    prints = {r.doc_id: simple_fingerprint(r.text) for r in docs.collect()}
    found = simhash_dups.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    assert {r.id: int(r.fingerprint, 16) for r in found} == prints
    assert {r.id: r.component_id for r in found} == simple_components(prints, 3)


def test_tiles_find_every_link_of_planted_fingerprints(spark):
    rng = random.Random(1)
    prints = []
    for _ in range(120):
        own = rng.getrandbits(64)
        prints += [own] + [own ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(3)]
    prints = sorted(set(prints))
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    links = simhash_dups.links_of(spark.createDataFrame(signed, "fp long"), 3)
    found = {r.node: r.root for r in components(links).collect()}
    expected = simple_components({s[0]: p for s, p in zip(signed, prints, strict=True)}, 3)
    assert {n: found.get(n, n) for n in expected} == expected


def test_many_links_between_two_tiles_become_a_forest():
    base = 0x0123456789ABCDEF
    near = np.array([base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)], np.uint64)
    near = np.unique(near)
    i, j = simhash_dups.linked(near[::2], near[1::2], False, 4)
    assert len(i) < len(near) and len(set(i.tolist()) | set(j.tolist())) == len(near)


def test_local_roots_follow_a_long_chain():
    n = 2_000
    order = np.random.default_rng(2).permutation(n)
    assert (local_roots(order[:-1], order[1:], n) == 0).all()


def test_components_of_a_star_a_chain_and_nothing(spark):
    rows = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (5, 0)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(1000, 1061), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def similar_components(texts, least=0.8):
    """Smallest id reachable by links of texts whose sets of five-word shingles have this similarity."""
    sets = {}
    for doc_id, text in texts.items():
        own = words(lowered(text))
        sets[doc_id] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}
    holders = {}
    for doc_id, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(doc_id)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for doc_id, own in sets.items():
        for other in {d for x in own for d in holders[x] if d > doc_id}:
            common = len(own & sets[other])
            if common >= least * (len(own) + len(sets[other]) - common) - 1e-9:
                a, b = find(doc_id), find(other)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_similar_groups_equal_all_pairs(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    expected = similar_components({r.doc_id: r.text for r in docs.collect()})
    found = {r.id: r.component_id for r in similar_dups.groups(docs).collect()}
    assert found == expected and len(set(expected.values())) < len(expected)


def test_edited_copies_are_found_in_hot_groups(spark, monkeypatch):
    """Copies with edits around the bound, in tiles of a few: same groups as all pairs."""
    monkeypatch.setattr(similar_dups, "TILE", 8)
    monkeypatch.setattr(similar_dups, "SHINGLE_TILE", 5)
    rng = random.Random(12)
    texts = {}
    for k in range(30):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 100, 300]))]
        for copy in range(rng.choice([1, 2, 3, 40 if k == 3 else 2])):
            edited = list(own)
            for _ in range(0 if copy == 1 else rng.randint(0, len(own) // 40)):
                edited[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            texts[len(texts)] = " ".join(edited)
    texts |= {1000: "", 1001: None, 1002: "a b", 1003: "A  B", 1004: "a b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.id: r.component_id for r in similar_dups.groups(docs).collect()} == similar_components(texts)


def test_keep_one_keeps_columns_and_one_of_each(spark):
    docs = odd_docs(spark)
    kept = similar_dups.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 8] and ids.count(None) == 1
    assert similar_dups.keep_one(empty_docs(spark)).count() == 0


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "one two three four five six", "b", {"k": 1}), (1, "one two three four five six", "a", {"k": 2}), (1, "one two three four five six", "a", {"k": 0})]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string, source string, more map<string, int>")
        assert [(r.source, r.more) for r in similar_dups.keep_one(docs).collect()] == [("a", {"k": 0})]


def test_tiles_of_one_hot_cell_are_paired_by_part(spark, monkeypatch):
    """All fingerprints have equal counts of bits in each block, so they share a cell; it has many parts."""
    monkeypatch.setattr(simhash_dups, "TILE", 16)
    rng = random.Random(3)
    prints = sorted({sum(sum(1 << (16 * b + k) for k in rng.sample(range(16), 2)) for b in range(4)) for _ in range(400)})
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    tiles = simhash_dups.tiles_of(spark.createDataFrame(signed, "fp long"))
    assert tiles.select("cell").distinct().count() == 1 and tiles.count() >= 20
    n = tiles.count()
    assert simhash_dups.tile_pairs(tiles, 4).where("same").count() == n
    assert simhash_dups.tile_pairs(tiles, 4).count() == n * (n + 1) // 2
    found = {r.node: r.root for r in components(simhash_dups.links_of(spark.createDataFrame(signed, "fp long"), 4)).collect()}
    expected = simple_components({s[0]: p for s, p in zip(signed, prints, strict=True)}, 4)
    assert {k: found.get(k, k) for k in expected} == expected


def test_near_duplicates_of_odd_rows_and_of_none(spark):
    found = simhash_dups.near_duplicates(odd_docs(spark)).collect()
    by_id = {r.id: r for r in found}
    assert len(found) == 10 and by_id[1].fingerprint == "0" * 16 and by_id[3].component_id == 1
    assert by_id[6].component_id == 5 and by_id[None].component_id == 5
    assert simhash_dups.near_duplicates(empty_docs(spark)).collect() == []


def brute_leaks(docs, items, similar=0.8):
    out = {}
    for doc_id, text in docs:
        own = words(lowered(text))
        for item_id, item in items:
            want = words(lowered(item))
            if not want or not own:
                continue
            size = min(5, len(want))
            n = len(want)
            best = max(
                (weighted(shingles(own[s : s + n], size), shingles(want, size)) for s in range(max(1, len(own) - n + 1)) if len(own) >= size),
                default=0,
            )
            if best >= similar:
                out[doc_id, item_id] = round(best, 9)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([15, 20, 40, 55])))) for k in range(12)]
    items += [(50, "Just three words"), (51, None), (52, ""), (53, "solitary"), (None, items[0][1] + " tail of it")]
    docs = []
    for k in range(60):
        own = rng.choices(vocabulary, k=rng.randint(0, 300))
        if k % 2:
            planted = words(rng.choice(items[:12])[1])
            if k % 3 == 0:
                planted[len(planted) // 2] = "changed"
            if k % 5 == 0:
                planted = [w.upper() for w in planted]
            at = rng.randint(0, len(own))
            own[at:at] = planted
        docs.append((k, " ".join(own)))
    docs += [(100, None), (101, ""), (102, "it says JUST three\nwords here"), (103, "solitary"), (104, items[0][1] * 2), (105, items[3][1][:-4])]
    doc_frame, item_frame = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(doc_frame.selectExpr("*", "1 AS w", "2 AS seeds", "3 AS row"), item_frame)
    got = {(r.id, r.item): round(r.similarity, 9) for r in found.collect()}
    assert got == brute_leaks(docs, items)
    kept = decontaminate.without_leaks(doc_frame, item_frame)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_leaks_with_replaced_ends_equal_brute_force(spark):
    rng = random.Random(6)
    items, docs = [], []
    for size, replaced in ((22, 2), (40, 4), (60, 6), (100, 10), (210, 21)):
        for k in range(30):
            item = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            cut, other = item[: size - replaced], [f"x{rng.randrange(10**6)}" for _ in range(replaced)]
            planted = cut + other if k % 2 else other + item[replaced:]
            items.append((len(items), " ".join(item)))
            docs.append((len(docs), " ".join(["before it", *planted, "and after"])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.id, r.item): round(r.similarity, 9) for r in found.collect()}
    expected = {k: v for own in zip(docs, items, strict=True) for k, v in brute_leaks(own[:1], own[1:]).items()}  # no others share words
    assert len(expected) == len(items) and got == expected


def test_leaks_with_swapped_parts_and_short_texts_equal_brute_force(spark):
    rng = random.Random(8)
    items, docs = [], []
    for k, (size, form) in enumerate([(48, "swap"), (41, "swap"), (200, "swap"), (15, 13), (40, 33), (57, 47), (30, 20), (57, "three")]):
        item = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        if isinstance(form, int):
            text = item[:form] if k % 2 else item[size - form :]
        else:
            a, b = size // 2, 2 * size // 3
            swapped = item[a:] + item[:a] if form == "swap" else item[b:] + item[a:b] + item[:a]
            text = [f"x{rng.randrange(10**6)}" for _ in range(60)] + swapped + ["after"] * 3
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(text)))
    items.append((20, items[0][1]))  # two items with the same words
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.id, r.item): round(r.similarity, 9) for r in found.collect()}
    assert got == brute_leaks(docs, items)
    assert {d for d, _ in got} >= {0, 2, 3, 4}
    assert {r.item: r.start for r in found.where("id = 0").collect()} == {0: 60, 20: 60}


def test_blocks_meet_every_fingerprint_within_the_radius(spark):
    rng = random.Random(5)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    own = [rng.getrandbits(64) for _ in range(300)]
    other = [p ^ sum(1 << b for b in rng.sample(range(64), k % 14)) for k, p in enumerate(own)]
    items = spark.createDataFrame([(k, 40, 5, signed(p)) for k, p in enumerate(own)], "key long, n int, size int, fp long")
    windows = spark.createDataFrame([(k, k, 0, 0, 40, 5, signed(p)) for k, p in enumerate(other)], "window long, id long, text_hash long, start int, n int, size int, fp long")
    met = {(r.window, r.key) for r in decontaminate._met_by_blocks(windows, items).collect()}
    expected = {(i, j) for i, a in enumerate(other) for j, b in enumerate(own) if (a ^ b).bit_count() <= decontaminate.RADIUS}
    assert met == expected and len(met) >= 250


def test_fingerprints_are_majority_bits(spark):
    rows = [(k, [f"w{k}-{j % 7}" for j in range(n)]) for k, n in enumerate((1, 2, 5, 300, 66_000))]
    frame = spark.createDataFrame(rows, "k int, w array<string>")
    for r in frame.select("w", decontaminate.fingerprint(F.col("w")).alias("fp"), F.transform("w", lambda x: F.xxhash64(x)).alias("h")).collect():
        votes = [sum(h >> b & 1 for h in r.h) for b in range(64)]
        assert r.fp % (1 << 64) == sum(1 << b for b, v in enumerate(votes) if 2 * v > len(r.h))


def test_both_routes_find_leaks(spark):
    """Passages within the radius meet by blocks; those with replaced ends, beyond it, by their shingles."""
    rng = random.Random(16)
    items, docs = [], []
    for k in range(60):
        item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        planted = item if k < 30 else item[:36] + [f"x{rng.randrange(10**6)}" for _ in range(4)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(["before", *planted, "after"])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id, r.item) for r in found) == [(k, k) for k in range(60)]
    assert all((r.route == "blocks") == (r.hamming <= decontaminate.RADIUS) for r in found)
    assert {r.route for r in found} == {"blocks", "shingles"}


@pytest.mark.parametrize("docs, items", [(True, False), (False, True), (False, False)])
def test_leaks_without_documents_or_items(spark, docs, items):
    rows = odd_docs(spark) if docs else empty_docs(spark)
    bench = spark.createDataFrame([(1, "a b c d e f g h")] if items else [], "item_id long, text string")
    assert decontaminate.leaks(rows, bench).collect() == []
    assert decontaminate.without_leaks(rows, bench).count() == rows.count()


def test_rows_with_null_ids_and_repeats_are_dropped_with_their_passage(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, passage), (1, passage), (1, passage), (1, "clean"), (None, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.without_leaks(docs, bench).collect()) == ["clean", "clean"]


def test_prints_of_different_keys_are_compared(spark):
    """Fingerprints within three bits join neighbourhoods whatever the least hashes are."""
    rows = [(1, 0b0), (2, 0b111), (3, 0b111), (4, (1 << 40) - 1), (5, (1 << 40) - 1 ^ 0b11), (6, 0b1111 << 50)]
    links = similar_dups.print_links(spark.createDataFrame(rows, "digest bigint, fp bigint")).collect()
    root = {d: d for d, _ in rows}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert root == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
