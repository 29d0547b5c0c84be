"""The trie of conversation prefixes, from sorted neighbours and union-find.

Different turn sequences are sorted over all tasks. The common prefix (LCP) of neighbours is an edge.
A task takes its edges in descending depth and joins components: each join makes the branching node at
that depth, and the nodes between two branchings have the members of the lower one. Neighbours of
other tasks are known by one row per task. The nodes that go on in another task are only those on the
common prefixes at both ends; a task gives its share of their sums, and the shares are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.common import stored

#: Bytes of a turn's code: the start of the SHA-256 of role and text.
CODE = 16
#: Ids that are joined into one string.
PIECE_IDS = 1 << 15
#: Open nodes up to which they are sent to every task.
BROADCAST_ROWS = 50_000

NODE_SCHEMA = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends binary, node binary, parent binary"
)
NAMES = [f.split()[0] for f in NODE_SCHEMA.split(", ")]


def turn_lists(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turns``: the turns of a conversation in order, as (code, bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    code = F.substring(F.sha2(said, 256), 1, 2 * CODE)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.struct(F.col(turn_col).alias("at"), code.alias("code"), F.octet_length(text).cast("bigint").alias("size")).alias("t"),
    )
    return rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def shared_starts(lists: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Give conversation c the first ``crc32(c) % most`` turns of conversation ``c - c % family``."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    own = lists.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family})
    starts = lists.select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("start"))
    both = own.join(starts.where(F.col("base") % family == 0), "base", "left")
    start = F.coalesce(F.slice("start", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv", F.concat(start, rest).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences of codes have in common at their start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // CODE
    x, y = (np.frombuffer(s, "u8", count=most // 8) for s in (a, b))
    return int(np.argmax(x != y)) * 8 // CODE


def prefix_keys(codes: bytes, depth: int) -> list[bytes]:
    """Names of the nodes at depths 0 to ``depth`` on the path of a sequence."""
    running, keys = hashlib.sha256(), []
    for d in range(depth + 1):
        keys.append(running.digest() + d.to_bytes(8, "big"))
        running.update(codes[CODE * d : CODE * (d + 1)])
    return keys


class Forest:
    """Components of the sorted sequences of one task; each stands for the node at its depth ``top``."""

    def __init__(self, sequences: list[bytes], counts: np.ndarray, lowest: np.ndarray, ends: list[bytes], lcp: np.ndarray):
        n = len(sequences)
        self.lcp = lcp  # lcp[i]: with the sequence before; the first and last with other tasks, -1: none
        self.up = list(range(n))
        self.top = [len(s) // CODE for s in sequences]
        self.first = list(range(n))
        self.last = list(range(n))
        self.n = counts.tolist()
        self.low = lowest.tolist()
        self.ends: list[bytes | None] = list(ends)
        self.leaves = [int(lcp[i + 1] < self.top[i]) for i in range(n)]
        self.children = [0] * n
        self.told = [0] * n  # bytes of the members' turns below the node
        self.kept = [0] * n  # bytes of the nodes below it, each once, that begin in this task
        self.waiting: list[list[int]] = [[] for _ in range(n)]
        self.records: list[tuple] = []
        self.parents: list[int] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def begins(self, i: int, depth: int) -> int:
        """Whether the component's node at this depth has its first member in this task."""
        return int(self.first[i] > 0 or depth > self.lcp[0])

    def close(self, i: int, bottom: int, sums: np.ndarray) -> tuple[int, int]:
        """Record the nodes from depth ``bottom`` to the top; (told, kept) below depth ``bottom - 1``."""
        record = len(self.records)
        values = (self.first[i], self.last[i], self.n[i], self.low[i], self.children[i], self.leaves[i])
        self.records.append((bottom, self.top[i], *values, self.told[i], self.kept[i], self.ends[i]))
        self.parents.append(-1)
        for child in self.waiting[i]:
            self.parents[child] = record
        low, top = max(bottom - 1, 0), self.top[i]
        seen = low if self.first[i] > 0 else max(low, min(int(self.lcp[0]), top))
        return self.told[i] + self.n[i] * int(sums[top] - sums[low]), self.kept[i] + int(sums[top] - sums[seen])

    def join(self, edge: int, sums: list[np.ndarray]) -> None:
        depth, sides = int(self.lcp[edge]), [self.find(edge - 1), self.find(edge)]
        told = kept = children = 0
        ends, waiting = None, []
        for i in sides:
            if self.top[i] == depth:  # it is the node already
                told, kept, children = told + self.told[i], kept + self.kept[i], children + self.children[i]
                ends = self.ends[i] if self.ends[i] is not None else ends
                more = self.waiting[i]
            else:
                a, b = self.close(i, depth + 1, sums[self.first[i]])
                told, kept, children = told + a, kept + b, children + self.begins(i, depth + 1)
                more = [len(self.records) - 1]
            waiting, more = (waiting, more) if len(waiting) >= len(more) else (more, waiting)
            waiting.extend(more)
        a, b = sides
        self.up[b] = a
        self.last[a] = self.last[b]
        self.n[a] += self.n[b]
        self.low[a] = min(self.low[a], self.low[b])
        self.leaves[a] += self.leaves[b]
        self.top[a], self.told[a], self.kept[a], self.children[a] = depth, told, kept, children
        self.ends[a], self.waiting[a] = ends, waiting
        self.waiting[b] = []


def nodes_of(sequences: list[bytes], sizes: list[np.ndarray], counts, lowest, ends, before: bytes | None, after: bytes | None) -> dict:
    """Columns of ``NODE_SCHEMA`` for the nodes of sorted, different sequences.

    ``before`` and ``after`` are the neighbours in other tasks. Nodes that go on there have a name in
    ``node`` and this task's share of the sums; nodes below such a node have its name in ``parent``.
    """
    n = len(sequences)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = -1 if before is None else common_turns(before, sequences[0])
    lcp[1:n] = [common_turns(a, b) for a, b in zip(sequences, sequences[1:], strict=False)]
    lcp[n] = -1 if after is None else common_turns(sequences[-1], after)
    sums = [np.concatenate(([0], np.cumsum(s))).astype(np.int64) for s in sizes]
    forest = Forest(sequences, np.asarray(counts), np.asarray(lowest), ends, lcp)
    inner = np.arange(1, n)
    for edge in inner[np.argsort(-lcp[1:n], kind="stable")].tolist():
        forest.join(edge, sums)
    whole = forest.find(0)
    forest.close(whole, 0, sums[forest.first[whole]])

    # Every record is a run of depths with the same members.
    records = forest.records
    bottom, top, first, last, n_convs, low, children, leaves, told, kept = (
        np.array([r[k] for r in records], np.int64) for k in range(10)
    )
    parents = np.asarray(forest.parents)
    lengths = top - bottom + 1
    run = np.repeat(np.arange(len(records)), lengths)
    depth = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + bottom[run]
    starts = np.cumsum([0, *map(len, sums)])[:-1]
    flat = np.concatenate(sums)
    at = lambda d: flat[starts[first[run]] + d]
    below = np.maximum(depth - 1, 0)
    seen = np.where(first[run] > 0, below, np.maximum(below, np.minimum(lcp[0], top[run])))
    saved = told[run] + n_convs[run] * (at(top[run]) - at(below)) - kept[run] - (at(top[run]) - at(seen))
    is_top, is_bottom = depth == top[run], depth == bottom[run]
    n_children = np.where(is_top, children[run], (first[run] > 0) | (depth + 1 > lcp[0]))

    left, right = prefix_keys(sequences[0], int(lcp[0])), prefix_keys(sequences[-1], int(lcp[n]))
    goes_left, goes_right = (first == 0), (last == n - 1)

    def name(r: int, d: int) -> bytes | None:
        if goes_left[r] and 0 <= d <= lcp[0]:
            return left[d]
        return right[d] if goes_right[r] and 0 <= d <= lcp[n] else None

    up = np.where(is_bottom, parents[run], run)
    node = [name(r, d) for r, d in zip(run.tolist(), depth.tolist(), strict=True)]
    parent = [name(r, d) if r >= 0 else None for r, d in zip(up.tolist(), (depth - 1).tolist(), strict=True)]
    parent_low = [int(low[r]) if r >= 0 and d > 0 and p is None else None for r, d, p in zip(up.tolist(), depth.tolist(), parent, strict=True)]
    last_ends = [records[r][10] if t else None for r, t in zip(run.tolist(), is_top.tolist(), strict=True)]
    columns = (low[run], depth, parent_low, n_convs[run], n_children, leaves[run], saved, last_ends, node, parent)
    return dict(zip(NAMES, columns, strict=True))


def _batch(columns: dict) -> pa.Table:
    types = [pa.binary() if f.endswith(" binary") else pa.int64() for f in NODE_SCHEMA.split(", ")]
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(columns.items(), types, strict=True)})


def _nodes_of_task(rows: pa.Table, bounds: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _batch({c: [] for c in NAMES})
    rows = rows.take(pa.compute.sort_indices(rows, [("codes", "ascending")]))
    sizes = [np.asarray(s, np.int64) for s in rows["sizes"].to_pylist()]
    before, after = bounds["before"][0].as_py(), bounds["after"][0].as_py()
    columns = [rows[c].to_numpy() for c in ("n", "low")]
    return _batch(nodes_of(rows["codes"].to_pylist(), sizes, *columns, rows["digest"].to_pylist(), before, after))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in the order of digest and id: the hash of a digest's ids if the task has them all, else pieces.

    The first and the last digest may go on in other tasks. Digests of very many ids become pieces too.
    """
    digest, ids, split, out = None, [], True, []

    def piece() -> tuple:
        return digest, ids[0], ",".join(map(str, ids)), None

    def flush(out: list) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["digest", "low", "piece", "sha"])

    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != digest:
                if ids:
                    whole = None if split else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                    out.append(piece() if split else (digest, None, None, whole))
                split = digest is None  # the task's first digest
                digest, ids = own, []
            elif len(ids) == PIECE_IDS:
                split = True
                out.append(piece())
                ids = []
            ids.append(conv)
        if out:
            yield flush(out)
            out = []
    if ids:
        yield flush([piece()])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash over pieces in the order of digest and first id; they are read one after the other."""
    digest, running = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([running.hexdigest()])], ["digest", "sha"])

    for batch in batches:
        for own, piece in zip(batch.column("digest").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if own == digest:
                running.update(b"," + piece.encode())
            else:
                if running is not None:
                    yield done()
                digest, running = own, hashlib.sha256(piece.encode())
    if running is not None:
        yield done()


def end_hashes(members: DataFrame) -> DataFrame:
    """``digest, sha``: SHA-256 of the ids of each digest of ``digest, conv``, ascending and comma-joined.

    A hash is computed from front to back, so the ids of one digest end in one task, as a stream of pieces.
    """
    order = members.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv")
    found = stored(order.select("digest", "conv").mapInArrow(_pieces, "digest binary, low bigint, piece string, sha string"), "trie-ends")
    split = found.where("sha IS NULL").repartition("digest").sortWithinPartitions("digest", "low")
    return found.where("sha IS NOT NULL").select("digest", "sha").unionByName(split.mapInArrow(_joined, "digest binary, sha string"))


def trie(lists: DataFrame) -> DataFrame:
    """``NODE_SCHEMA``'s first seven columns and ``ends_sha256``, a row per prefix of ``conv, turns``.

    ``conv`` is not null and unique, ``turns`` an array of (…, code, size) as ``turn_lists`` makes it; a
    conversation may have no turns. No conversations: no rows, not even a root.
    """
    codes = F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), ""))
    rows = lists.select("conv", codes.alias("codes"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = stored(rows.withColumn("digest", F.unhex(F.sha2("codes", 256))), "trie-conversations")
    different = rows.groupBy("digest", "codes", "sizes").agg(F.min("conv").alias("low"), F.count(F.lit(1)).alias("n"))
    ordered = different.repartitionByRange("codes").sortWithinPartitions("codes")
    ordered = stored(ordered.withColumn("task", F.spark_partition_id()), "trie-sequences")

    # One row per task, so one window over them is small.
    ends = ordered.groupBy("task").agg(F.min("codes").alias("head"), F.max("codes").alias("tail"))
    order = Window.orderBy("task")
    bounds = ends.select("task", F.lag("tail").over(order).alias("before"), F.lead("head").over(order).alias("after"))
    shares = ordered.groupBy("task").cogroup(bounds.groupBy("task"))
    shares = stored(shares.applyInArrow(_nodes_of_task, NODE_SCHEMA), "trie-nodes")

    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = shares.where("node IS NOT NULL").groupBy("node", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), *total, F.max("ends").alias("ends"))
    merged = stored(merged, "trie-open-nodes")
    named = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    named = F.broadcast(named) if merged.count() <= BROADCAST_ROWS else named
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inside = shares.where("node IS NULL")
    below = inside.where("parent IS NOT NULL").drop("parent_conv_id", "node")
    below = below.unionByName(merged.where("parent IS NOT NULL").drop("node")).join(named, "parent")
    nodes = inside.where("parent IS NULL").select(*columns)
    nodes = nodes.unionByName(below.withColumnRenamed("found", "parent_conv_id").select(*columns))
    nodes = nodes.unionByName(merged.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*columns))

    inner = nodes.where("ends IS NULL").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).drop("ends")
    hashed = nodes.where("ends IS NOT NULL").join(end_hashes(rows).select(F.col("digest").alias("ends"), F.col("sha").alias("ends_sha256")), "ends")
    return inner.unionByName(hashed.drop("ends"))


def conversation_trie(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    rebuild=None,
) -> DataFrame:
    """A row per different start (role and text of the first d turns) of the conversations in ``turns``.

    ``conv_id`` the smallest member, ``depth`` d, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (nodes without children in its subtree), ``saved_tokens`` (over its
    subtree, members less one times the UTF-8 bytes of the node's last text), ``ends_sha256`` (of the
    ids of members that end here, ascending, comma-joined).

    Turns are ordered by ``turn_col``, null first; turns with an equal number by the hash of role and
    text; repeated rows are turns of their own. Null roles and texts are empty. Rows with a null
    conversation id belong to none. ``rebuild`` may change the lists before (``shared_starts``). An empty
    table gives no rows. Only the named columns are read. A conversation's codes, 16 bytes a turn, are one
    value of one row.
    """
    lists = turn_lists(turns, conv_col, turn_col, role_col, text_col)
    return trie(rebuild(lists) if rebuild else lists)
