"""Vector near-duplicates, hard negatives and the conversation trie against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from test_pairs import SMALL

import __spark_entry__ as entry
from sediment.llm import hard_negatives, prefix_trie, vector_dups

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
ODD_VECTORS = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [math.nan, 1.0], 1), (6, [math.inf, 1.0], 1),
    (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (None, [2.0, 4.0], 1), (9, [1.0, 2.0, 0.0], 1),
    (10, [-1.0, -2.0], 1), (11, [3e38, 3e38], 2), (12, [1e-38, 1e-38], 2), (13, [1.0, 2.0], 2), (14, [5.0], 3),
]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def cosine(a, b):
    a, b = (np.asarray(v, float) / max(map(abs, v)) for v in (a, b))
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def brute_links(rows, least=0.93):
    """(n_links, component) for each row in order."""
    near = {i: set() for i in range(len(rows))}
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if label is not None and label == other and usable(v) and usable(w) and len(v) == len(w) and any(v) and any(w):
                if cosine(v, w) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), component, rows[i][0] is not None and rows[i][0] == component))
    return out


def planted_vectors(rng, n=400, dim=24):
    rows = []
    for k in range(n):
        v = rng.normal(size=dim)
        rows.append((len(rows), v, k % 4))
        for _ in range(rng.integers(0, 4) if k % 5 == 0 else 0):
            rows.append((len(rows), v + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25, 0.4]), k % 4 if rng.random() < 0.8 else 9))
    return [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]


def by_text(rows):
    return sorted(map(repr, rows))


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dups, "TILE", 16)
    rows = planted_vectors(np.random.default_rng(1))
    rows += [(5000 + k, [float(x) for x in np.eye(24)[0]], 1) for k in range(40)]  # a hot vector
    rows += ODD_VECTORS
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS cid", "3 AS weight", "4 AS tile")
    found = [tuple(r) for r in vector_dups.near_duplicates(frame).collect()]
    assert by_text(found) == by_text(brute_links(rows))


def test_code_bounds_hold_for_every_near_pair_and_estimates_are_unbiased():
    rng, dim = np.random.default_rng(3), 64
    a = vector_dups.unit(rng.normal(size=(20_000, dim)))
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * noise
    turn = vector_dups.rotation(dim)
    assert np.allclose(turn @ turn.T, np.eye(dim))
    codes, factors = vector_dups.encode(b, turn)
    t = ((a @ turn) * vector_dups.signs(codes.tobytes(), len(b), dim)).sum(1)
    assert (t >= vector_dups.least_code_cosine(factors, dim, 0.93, 6.0)).all()
    assert abs((t / factors).mean() - 0.93) < 0.003
    far = ((a[::-1] @ turn) * vector_dups.signs(codes.tobytes(), len(b), dim)).sum(1)
    assert (far >= vector_dups.least_code_cosine(factors, dim, 0.93, 6.0)).mean() < 0.01


def test_vectors_of_one_label_and_none(spark):
    assert vector_dups.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(k, [1.0, k / 1000], 1) for k in range(300)]
    found = [tuple(r) for r in vector_dups.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()]
    assert by_text(found) == by_text(brute_links(rows))


def brute_negatives(rows, anchors, n_positives=5, n_negatives=10):
    some = [(i, n, lab, [math.floor(256 * x) for x in v]) for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and usable(v)]
    out = []
    for i, n, label, v in some:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m, other) for j, m, other, w in some if m != n and len(w) == len(v))
        for p, positive, _, _ in [s for s in scored if s[3] == label][:n_positives]:
            fit = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:n_negatives]
            out += [(i, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit)]
    return out


@pytest.mark.parametrize("tile, leaf", [(16_384, 256), (64, 4)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, tile, leaf):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", leaf)
    monkeypatch.setattr(hard_negatives, "FANOUT", 4)
    rng = np.random.default_rng(7)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=6) / 2], int(rng.integers(0, 4))) for k in range(500)]
    rows += [(1000 + k, rows[30][1], k % 3) for k in range(90)] + [(30, rows[30][1], 1)]  # many equal scores and rows
    rows += [r for r in ODD_VECTORS if r[0] is None or r[0] not in (11, 12)] + [(2000, [1e15, 1.0, 0.0, 0.0, 0.0, 2.0], 2)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS row", "3 AS tile")
    found = hard_negatives.mine(frame, "id % 10 = 0 AND id < 1000")
    assert by_text(tuple(r) for r in found.collect()) == by_text(brute_negatives(rows, lambda i: i % 10 == 0 and i < 1000))


def test_tree_opens_few_leaves_of_clustered_rows(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 16)
    rng = np.random.default_rng(2)
    values = np.floor(np.repeat(rng.normal(size=(64, 3)) * 1000, 64, axis=0) + rng.normal(size=(4096, 3)))
    at = hard_negatives.str_order(values, [0, 1, 2], 16)
    assert sorted(at.tolist()) == list(range(4096))
    tile = {"rows": at.tolist(), "ids": at.tolist(), "labels": ["a"] * 4096, "values": values[at].tobytes()}
    opened = []
    tree = hard_negatives.Tree(tile)
    one = hard_negatives.Search(5, hard_negatives.LOW, hard_negatives.HIGH, hard_negatives.LOW, "a", True, -1)
    offer = one.offer
    one.offer = lambda *a: (opened.append(1), offer(*a))
    tree.search(values[0], [one])
    scores = values @ values[0]
    assert (-one.best[:, 0]).tolist() == sorted(scores.tolist())[::-1][:5] and len(opened) < 30


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), "id = 1").collect() == []
    assert hard_negatives.mine(spark.createDataFrame(ODD_VECTORS, VECTORS), "false").collect() == []


def rebuilt(turns):
    own = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows, key=lambda t: t[:2])] for c, rows in own.items()}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + rows[h:]
    return out


def brute_trie(convs):
    members = collections.defaultdict(list)
    for c, rows in sorted(convs.items()):
        for d in range(len(rows) + 1):
            members[tuple(rows[:d])].append(c)
    children, out = collections.defaultdict(list), []
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        own = len(key[-1][1].encode()) if key else 0
        saved[key] = (len(members[key]) - 1) * own + sum(saved[k] for k in children[key])
        ends = ",".join(str(c) for c in members[key] if len(convs[c]) == len(key))
        parent = members[key[:-1]][0] if key else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((members[key][0], len(key), parent, len(members[key]), len(children[key]), leaves[key], saved[key], sha))
    return out


TRIE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ODD_TURNS = [
    (None, 0, "user", "x"), (900, None, "user", "null first"), (900, 0, None, None), (900, 3, "", ""), (901, 0, "user", "é" * 3000),
    (902, 0, "us", "er1"), (903, 0, "use", "r1"), (904, 5, "user", "later"), (904, -2, "user", "earlier"), (905, 1, "a", "twice"), (905, 1, "a", "twice"),
]


@pytest.mark.parametrize("parts, piece", [(1, 1 << 15), (7, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, parts, piece):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(5)
    turns = [(c, t, "u" if t % 2 else "a", rng.choice("xyz") * rng.choice([1, 1, 1, 2])) for c in range(200) for t in range(rng.choice([0, 1, 2, 3, 5, 12]))]
    turns += [(c, t, "u", "hot") for c in range(400, 480) for t in range(6)]
    turns += [(300, t, "u", "long") for t in range(2000)] + [(305, t, "u", "long") for t in range(1500)]
    turns += ODD_TURNS
    rng.shuffle(turns)
    frame = spark.createDataFrame(turns, TURNS).selectExpr("*", "1 AS conv", "2 AS codes", "3 AS n", "4 AS node")
    found = prefix_trie.conversation_trie(frame, rebuild=prefix_trie.shared_starts).select(*TRIE_COLUMNS)
    got = by_text(tuple(r) for r in found.collect())
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == by_text(brute_trie(rebuilt(turns)))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_forest_of_random_sequences_in_one_and_in_several_tasks(seed):
    rng = random.Random(seed)
    codes = sorted({b"".join(rng.choice([b"a", b"b"]) * 16 for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 25))})
    counts = [rng.randint(1, 3) for _ in codes]

    def run(groups):
        rows, at = [], 0
        for k, size in enumerate(groups):
            some = codes[at : at + size]
            before, after = codes[at - 1] if at else None, codes[at + size] if at + size < len(codes) else None
            sizes = [np.arange(1, len(s) // 16 + 1) for s in some]
            lows = list(range(at, at + size))
            columns = prefix_trie.nodes_of(some, sizes, counts[at : at + size], lows, some, before, after)
            rows += [dict(zip(columns, map(lambda v: v.item() if hasattr(v, "item") else v, r), strict=True)) for r in zip(*columns.values(), strict=True)]
            at += size
        merged, out = {}, []
        for r in rows:
            if r["node"] is None:
                out.append(r)
            elif r["node"] in merged:
                m = merged[r["node"]]
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    m[c] += r[c]
                m["conv_id"] = min(m["conv_id"], r["conv_id"])
                m["ends"] = r["ends"] if m["ends"] is None else m["ends"]
            else:
                merged[r["node"]] = dict(r)
        out += merged.values()
        for r in out:
            r["parent_conv_id"] = merged[r["parent"]]["conv_id"] if r["parent"] else r["parent_conv_id"]
        return sorted((r["depth"], r["conv_id"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends"]) for r in out)

    convs = {}
    for k, c in enumerate(codes):
        for copy in range(counts[k]):
            convs[k + copy / 10] = [(c[16 * d : 16 * (d + 1)], "x" * (d + 1)) for d in range(len(c) // 16)]
    expected = sorted((d, int(c), None if p is None else int(p), n, k, leaves, saved) for c, d, p, n, k, leaves, saved, _ in brute_trie(convs))
    whole = run([len(codes)])
    assert [r[:-1] for r in whole] == expected
    cuts, left = [], len(codes)
    while left:
        cuts.append(rng.randint(1, left))
        left -= cuts[-1]
    assert run(cuts) == whole


def test_new_queries_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = [tuple(r) for r in entry.queries()["op11_vector_dups"](spark, SMALL).collect()]
    assert by_text(found) == by_text(brute_links(rows))
    moved = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows]
    negatives = entry.queries()["op12_hard_negatives"](spark, SMALL)
    assert by_text(tuple(r) for r in negatives.collect()) == by_text(brute_negatives(moved, lambda i: i % 100 == 0))
    turns = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    trie = entry.queries()["op13_prefix_trie"](spark, SMALL)
    assert trie.columns == TRIE_COLUMNS
    assert by_text(tuple(r) for r in trie.collect()) == by_text(brute_trie(rebuilt(turns)))
