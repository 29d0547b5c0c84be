"""Stateful stream operators that Spark's aggregates cannot express: counts that hand out late rows, and
the newest row of a key over all micro-batches.

Both run as ``transformWithState``: one small state value per key, kept by RocksDB outside the heap.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Processors are sent by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
#: Rows and bytes of rows that a task packs at once.
PACK_ROWS, PACK_BYTES = 200_000, 32 << 20
#: Rows of packs that are handed out at once, about.
OUT_ROWS = 10_000


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` needs this state store; call it before the query is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class HourCounter(StatefulProcessor):
    """Counts the rows of an hour until the watermark has passed it, then hands the count out and forgets it.

    Rows come as packs of one hour each, with their number. Packs of an hour that has ended are handed
    out as they are instead of being lost.
    """

    def __init__(self, names: Sequence[str]):
        self.names = list(names)

    def _row(self, *values) -> Row:
        return Row(**dict(zip(self.names, values, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        end = (int(key[0]) + 1) * HOUR_MS
        if end <= timerValues.getCurrentWatermarkInMs():
            for row in rows:
                yield self._row(*key, "late", row["_n"], bytes(row["_pack"]))
            return
        new = sum(row["_n"] for row in rows)
        if self.count.exists():
            new += self.count.get()[0]
        else:
            self.handle.registerTimer(end)
        self.count.update((new,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n = self.count.get()[0]
        self.count.clear()
        yield self._row(*key, "final", n, None)

    def close(self) -> None:
        pass


def packed(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keys, _n, _pack``: rows of a key that a task has at hand as one value, in Arrow's format.

    A task holds ``PACK_ROWS`` rows at a time, or fewer if they have more than ``PACK_BYTES``.
    """
    most_rows, most_bytes, keys, columns = PACK_ROWS, PACK_BYTES, list(keys), list(columns)
    kinds = T.StructType([rows.schema[k] for k in keys])
    schema = to_arrow_schema(T.StructType([rows.schema[c] for c in columns]))

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        numbers = np.zeros(len(table), np.int64)  # equal for rows of a key
        for column in table.columns[: len(keys)]:
            codes = column.combine_chunks().dictionary_encode(null_encoding="encode")
            numbers = numbers * len(codes.dictionary) + codes.indices.to_numpy()
            numbers = np.unique(numbers, return_inverse=True)[1]
        order = np.argsort(numbers, kind="stable")
        table, numbers = table.take(pa.array(order)), numbers[order]
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        ends = np.append(starts[1:], len(numbers))
        body = table.select(range(len(keys), table.num_columns)).rename_columns(columns).cast(schema)
        body = body.combine_chunks().to_batches()[0]
        packs = [body.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = table.select(range(len(keys))).take(pa.array(starts)).combine_chunks().to_batches()[0]
        more = [pa.array(ends - starts, pa.int64()), pa.array(packs, pa.binary())]
        return pa.RecordBatch.from_arrays([*found.columns, *more], [*keys, "_n", "_pack"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n, size = n + batch.num_rows, size + batch.nbytes
            if n >= most_rows or size >= most_bytes:
                yield of(held)
                held, n, size = [], 0, 0
        if held:
            yield of(held)

    # Rows of a key meet in one task first, so that packs are large.
    dealt = rows.repartition(*keys).select(*keys, *[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)])
    return dealt.mapInArrow(pack, T.StructType([*kinds.fields, T.StructField("_n", T.LongType()), T.StructField("_pack", T.BinaryType())]))


def unpacked(found: DataFrame, keys: Sequence[str], fields: Sequence[T.StructField]) -> DataFrame:
    """``keys, kind, visits`` and the rows of packs, one by one; nulls where there is no pack."""
    given = [found.schema[c] for c in (*keys, "kind", "visits")]
    schema = to_arrow_schema(T.StructType(list(fields)))
    out = T.StructType([*given, *[T.StructField(f"row_{f.name}", f.dataType) for f in fields]])
    lead = len(given)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(lead).is_null()
            counts = batch.filter(whole)
            if counts.num_rows:
                yield pa.RecordBatch.from_arrays([*counts.columns[:lead], *[pa.nulls(counts.num_rows, f.type) for f in schema]], out.names)
            late, held, which, n = batch.filter(pc.invert(whole)), [], [], 0
            for k in range(late.num_rows):
                held.append(pa.ipc.read_record_batch(pa.py_buffer(late.column(lead)[k].as_py()), schema))
                which.append(k)
                n += held[-1].num_rows
                if n >= OUT_ROWS or k == late.num_rows - 1:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    of = pa.array(np.repeat(which, [h.num_rows for h in held]))
                    keys_of = [column.take(of) for column in late.columns[: lead - 1]]
                    yield pa.RecordBatch.from_arrays([*keys_of, pa.array(np.ones(n, np.int64)), *rows.columns], out.names)
                    held, which, n = [], [], 0

    return found.select(*[f.name for f in given], "_pack").mapInArrow(unpack, out)


def counts_and_late_rows(
    rows: DataFrame, at: str, by: Sequence[str] = (), delay: str = "90 minutes", spread: str | None = None, salts: int = 16
) -> DataFrame:
    """``hour, by…, kind, visits`` and the rows' columns: final counts per hour, and late rows.

    A ``final`` row comes once the watermark, ``delay`` behind the newest row of earlier batches, has passed
    the end of the hour; its state is dropped then. A row that comes for such an hour is a ``late`` row
    with its own columns. With ``spread``, a column that differs between rows, an hour is counted in
    ``salts`` parts, so that one with very many rows is not one task's work: add the counts up. A row
    without a time is late at once: it belongs to no hour. Write the result in ``append`` mode. All rows
    of an hour in a batch are late or none is, so they pass the counter as packs (``packed``).
    """
    keep_state_in_rocksdb(rows.sparkSession)
    hour = F.coalesce(F.floor(F.unix_seconds(at) / 3600), F.lit(-(2**40))).cast("bigint")
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int") if spread else F.lit(0)
    # The watermark's own column is dropped again: with it, Spark would drop late rows before they are seen.
    marked = rows.withColumn("_mark", F.col(at)).withWatermark("_mark", delay).drop("_mark")
    keys = ["_hour", *by, "_salt"]
    packs = packed(marked.withColumns({"_hour": hour, "_salt": salt}), keys, rows.columns)
    fields = [T.StructField("_hour", T.LongType()), *[rows.schema[c] for c in by], T.StructField("_salt", T.IntegerType())]
    fields += [T.StructField("kind", T.StringType()), T.StructField("visits", T.LongType()), T.StructField("_pack", T.BinaryType())]
    counter = HourCounter([f.name for f in fields])
    found = packs.groupBy(*keys).transformWithState(counter, T.StructType(fields), "append", "eventTime")
    found = unpacked(found, keys, rows.schema.fields)
    hours = F.when(F.col("_hour") > -(2**40), F.timestamp_seconds(F.col("_hour") * 3600)).alias("hour")
    return found.select(hours, *by, "kind", "visits", *[F.col(f"row_{c}") for c in rows.columns])


class NewestRows(StatefulProcessor):
    """Hands out a key's newest row of a batch if it is newer than all that came before.

    A state value holds the newest rows of all keys of a slot, each with the time when it is forgotten, so
    that a call to the state store serves many keys. The slot itself ends with the last of them.
    """

    def __init__(self, schema: T.StructType, key: Sequence[str], order: Sequence[str], ttl_ms: int):
        self.schema, self.ttl_ms = schema, ttl_ms
        self.key, self.order = ([schema.names.index(c) for c in some] for some in (key, order))

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = T.StructType([*self.schema.fields, T.StructField("_until", T.LongType())])
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("rows", T.ArrayType(entry))]), self.ttl_ms)

    def _rank(self, row: Sequence) -> tuple:
        return tuple((row[k] is not None, row[k]) for k in self.order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, names = timerValues.getCurrentProcessingTimeInMs(), self.schema.names
        kept = self.newest.get() if self.newest.exists() else None
        held = {tuple(r[k] for k in self.key): tuple(r) for r in (kept[0] if kept else ()) if r[-1] > now}
        changed = {}
        for row in rows:
            row = (*[row[name] for name in names], now + self.ttl_ms)
            name = tuple(row[k] for k in self.key)
            if name not in held or self._rank(row) > self._rank(held[name]):
                held[name] = changed[name] = row
        if changed:
            self.newest.update(([*held.values()],))
        for row in changed.values():
            yield Row(**dict(zip(names, row[:-1], strict=True)))

    def close(self) -> None:
        pass


def newest_rows(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], keep: str | None = None, slots: int = 1 << 14
) -> DataFrame:
    """A stream of changes: the newest row of each key, whenever a batch brings one.

    ``order`` says which of two rows is newer, a null first; it should not tie. A batch gives at most one
    row for a key, and only one newer than all before, so the row of the last batch is the key's row.
    ``keep`` (``7 days``) is how long a key that gets no new row is remembered; after that an old row
    would count as new. Spark then runs a batch at every trigger, to forget keys, so a drain would not
    end: use a fixed interval. The keys are then kept in ``slots`` by their hash, and a batch reads and
    writes the slots it has rows for. Null keys are one key. Write the result in ``update`` mode.
    """
    spark = rows.sparkSession
    keep_state_in_rocksdb(spark)
    if keep is None:
        # The time of the batch is the same in all its rows, and another one in every batch.
        marked = rows.withColumn("_came", F.current_timestamp())
        earlier = (-F.unix_micros("_came")).alias("_earlier")  # of equal rows, that of the earlier batch is kept
        newest = F.max_by(F.struct(*marked.columns), F.struct(*order, earlier)).alias("_newest")
        found = marked.groupBy(*key).agg(newest).select("_newest.*")
        return found.where(F.col("_came") == F.current_timestamp()).drop("_came")
    amount, unit = keep.split()
    ttl = int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1000
    processor = NewestRows(rows.schema, key, order, ttl)
    slot = F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")
    return rows.withColumn("_slot", slot).groupBy("_slot").transformWithState(processor, rows.schema, "update", "processingTime")


def latest_changes(changes: DataFrame, key: Sequence[str], batch: Column) -> DataFrame:
    """The current rows of a table of changes: the one of the last batch for each key."""
    rest = [c for c in changes.columns if c not in key]
    last = F.max_by(F.struct(*rest), batch).alias("_last")
    return changes.groupBy(*key).agg(last).select(*key, "_last.*")
