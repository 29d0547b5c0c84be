"""A stored message log as a streaming source with offsets, start positions and bounded batches.

The log has a folder per topic partition with files sorted by offset. The source reads it as a topic: a
batch is a range of offsets for each partition, cut into reading tasks; where to start is the beginning,
the end or an offset for each partition; and a batch has at most so many offsets.

The position up to which batches were planned is kept in a small file, written before Spark notes the
batch. A restarted stream gets the batches it has noted from its checkpoint and goes on from the file.
If the file is behind the checkpoint, the stream ends with an error instead of reading rows twice.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sediment.sources.messages import MESSAGE_SCHEMA, Start

# The reader is sent by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "message_log"
ARROW_SCHEMA = pa.schema(
    [("key", pa.string()), ("value", pa.string()), ("topic", pa.string()), ("partition", pa.int32()),
     ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC"))]
)
#: Offsets that one reading task takes.
TASK_ROWS = 250_000
#: Bytes of a row group, about: what lies outside a task's offsets is skipped by row groups.
GROUP_BYTES = 16 << 20
#: Bytes of a column that a reading task holds, and rows that it hands out at once.
READ_BYTES, READ_ROWS = 1 << 20, 10_000


def write_log(messages: DataFrame, path: str) -> None:
    """Append messages to a log: a folder per partition, files sorted by offset.

    Files that are read later must hold later offsets of their partition.
    """
    names = [f.split()[0] for f in MESSAGE_SCHEMA.split(", ")]
    dealt = messages.select(*names).repartitionByRange("partition", "offset")
    rows = dealt.sortWithinPartitions("partition", "offset")
    writer = rows.write.mode("append").partitionBy("partition").option("parquet.block.size", str(GROUP_BYTES))
    writer.option("parquet.page.row.count.limit", "20000").parquet(path)


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of what pyarrow can open: a local path or a URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    """Offsets ``first`` to ``last``, that one not included, and the files that have some of them."""

    partition: int
    first: int
    last: int
    files: tuple[str, ...] = ()


class LogReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.positions = options["path"], options["positions"]
        self.start: Start = json.loads(options.get("start", '"end"'))
        self.max_rows = int(options["maxrows"]) if "maxrows" in options else None
        self.task_rows = int(options.get("taskrows", TASK_ROWS))
        self.bounds: dict[str, tuple[int, int, int]] = {}
        self.planned: dict[str, int] | None = None
        self.first: dict[str, int] | None = None

    def _ends(self) -> dict[int, tuple[int, int]]:
        """First offset and end of each partition, from the footers of files not seen before."""
        files, root = open_path(self.path)
        for found in files.get_file_info(pafs.FileSelector(root, recursive=True)):
            folder, name = found.path.rpartition("/")[::2]
            if found.is_file and name.endswith(".parquet") and found.path not in self.bounds:
                partition = int(folder.rpartition("partition=")[2])
                with files.open_input_file(found.path) as source:
                    footer = pq.ParquetFile(source).metadata
                at = footer.schema.names.index("offset")
                groups = [footer.row_group(g).column(at).statistics for g in range(footer.num_row_groups)]
                if groups:
                    self.bounds[found.path] = partition, min(g.min for g in groups), max(g.max for g in groups) + 1
        ends: dict[int, tuple[int, int]] = {}
        for partition, low, end in self.bounds.values():
            a, b = ends.get(partition, (low, end))
            ends[partition] = min(a, low), max(b, end)
        return ends

    def _begin(self) -> dict[str, int]:
        """Where a new stream starts; partitions that a list leaves out are not read."""
        ends = self._ends()
        if self.start == "beginning":
            return {str(p): low for p, (low, _) in ends.items()}
        if self.start == "end":
            return {str(p): end for p, (_, end) in ends.items()}
        return {str(p): int(o) for p, o in self.start.items()}

    def _load(self) -> dict[str, dict[str, int]] | None:
        files, path = open_path(self.positions)
        if not files.get_file_info(path).is_file:
            return None
        with files.open_input_stream(path) as source:
            return json.loads(source.read())

    def _save(self, planned: dict[str, int]) -> None:
        """Keep the start of the stream too: its first batch may have to be run again."""
        files, path = open_path(self.positions)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{path}.new") as out:
            out.write(json.dumps({"first": self.first, "planned": planned}).encode())
        files.move(f"{path}.new", path)

    def _resume(self) -> dict[str, int]:
        if self.planned is None:
            kept = self._load()
            self.first, self.planned = (kept["first"], kept["planned"]) if kept else (self._begin(),) * 2
        return self.planned

    def initialOffset(self) -> dict:
        self._resume()
        return self.first

    def latestOffset(self) -> dict:
        planned, ends = self._resume(), self._ends()
        if not isinstance(self.start, dict):  # a partition that came later is read from its beginning
            planned = {str(p): low for p, (low, _) in ends.items()} | planned
        share = max(1, self.max_rows // max(1, len(planned))) if self.max_rows else None
        new = {}
        for p, at in sorted(planned.items()):
            end = max(at, ends.get(int(p), (0, at))[1])
            new[p] = end if share is None else min(end, at + share)
        if new != self.planned:
            self._save(new)
            self.planned = new
        return new

    def partitions(self, start: dict, end: dict) -> list[Range]:
        lows, out = {str(p): low for p, (low, _) in self._ends().items()}, []
        for p, last in sorted(end.items()):
            first = start.get(p, lows.get(p, last))
            if last < first:
                raise ValueError(f"{self.positions} is behind the checkpoint: partition {p} would go back from {first} to {last}")
            files = sorted((low, end, path) for path, (number, low, end) in self.bounds.items() if number == int(p))
            for at in range(first, last, self.task_rows):
                to = min(at + self.task_rows, last)
                out.append(Range(int(p), at, to, tuple(path for low, end, path in files if low < to and end > at)))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Pages are decoded one after the other, so a task's memory does not follow the size of files."""
        files, _ = open_path(self.path)
        names = [f.name for f in ARROW_SCHEMA if f.name != "partition"]
        for path in partition.files:
            with files.open_input_file(path) as source:
                stored = pq.ParquetFile(source, buffer_size=READ_BYTES, pre_buffer=False, coerce_int96_timestamp_unit="us")
                at = stored.metadata.schema.names.index("offset")
                bounds = [stored.metadata.row_group(g).column(at).statistics for g in range(stored.metadata.num_row_groups)]
                groups = [g for g, x in enumerate(bounds) if x.min < partition.last and x.max >= partition.first]
                for batch in stored.iter_batches(READ_ROWS, row_groups=groups, columns=names, use_threads=False):
                    offset = batch.column("offset")
                    batch = batch.filter(pc.and_(pc.greater_equal(offset, partition.first), pc.less(offset, partition.last)))
                    if batch.num_rows:
                        number = pa.array([partition.partition] * batch.num_rows, pa.int32())
                        columns = [number if f.name == "partition" else batch.column(f.name).cast(f.type) for f in ARROW_SCHEMA]
                        yield pa.RecordBatch.from_arrays(columns, schema=ARROW_SCHEMA)


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGE_SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def stream_log(
    spark: SparkSession,
    path: str,
    positions: str,
    start: Start = "end",
    max_rows: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Stream of a stored log in the columns of a topic.

    ``start``: ``beginning``, ``end`` or ``{partition: offset}``, for a stream without a ``positions`` file.
    A batch has at most ``max_rows`` offsets, shared evenly by the partitions (one each at least), and a
    reading task at most ``task_rows``. A ``positions`` file belongs to one checkpoint. A trigger of fixed intervals
    gives the batches; a drain (``availableNow``) takes only one batch, as Spark asks this kind of source once.
    """
    spark.dataSource.register(MessageLog)
    if not isinstance(start, str):
        start = {str(p): int(o) for p, o in start.items()}
    reader = spark.readStream.format(FORMAT).option("path", path).option("positions", positions)
    reader = reader.option("start", json.dumps(start)).option("taskrows", str(task_rows))
    if max_rows:
        reader = reader.option("maxrows", str(max_rows))
    return reader.load()


def committed_offsets(spark: SparkSession, positions: str, group: str, topic: str) -> DataFrame:
    """The position of a stream as ``reports.consumer_lag`` takes it."""
    kept = LogReader({"path": "", "positions": positions})._load() or {"planned": {}}
    rows = [(group, topic, int(p), o) for p, o in sorted(kept["planned"].items())]
    return spark.createDataFrame(rows, "group_id STRING, topic STRING, partition INT, committed_offset BIGINT")


def end_offsets(messages: DataFrame) -> DataFrame:
    """End of each topic partition of a stored log."""
    return messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
