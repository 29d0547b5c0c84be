"""A Parquet table kept in daily folders, with a small list that says which folders are current.

Spark cannot replace rows of a Parquet table in place. A change is therefore written to a new folder
``_commit=<n>-<id>/event_date=<day>/`` and becomes visible when the list of current folders,
``_published/<n>.json``, is written as its last step. A reader sees the state before or after a
change, never half of it; a job that dies earlier leaves folders nobody reads. The list has a few
entries per day kept, so it stays small whatever the size of the data. A change is planned from one
state and can only be published as the version after it: of two writers, as an ingest job and a nightly
delete, one gets ``Conflict``, has changed nothing, and runs again. Publishing needs a rename that
fails if the target exists; plain object stores have none, so keep the lists on a file system that has.

With a key the table is an upsert table in one of two modes. ``write``: each batch rewrites the days
it touches, reads are plain. ``read``: a batch is only appended as a delta, reads put the newest row
first, and ``fold`` merges the deltas later; this is the mode for small batches into large days. A
delta is not split by day, so a batch with rows for many days is still a few files.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.dedup import keep_latest_arrival

COMMIT = "_commit"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
FEW_IDS = 1_000
GRACE_SECONDS = 24 * 3600


def _between_bounds(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows between the smallest and largest key, before a join with the keys.

    The bounds reach the scan, so row groups and files outside them are skipped. Keys that grow with
    time leave only the recent days.
    """
    bounds = keys.agg(*[f(n) for n in on for f in (F.min, F.max)]).first()
    for i, name in enumerate(on):
        low, high = bounds[2 * i], bounds[2 * i + 1]
        if low is None:
            return rows.where(F.lit(False))
        rows = rows.where(F.col(name).between(F.lit(low), F.lit(high)))
    return rows


class Conflict(RuntimeError):
    """Another writer published first."""


class DayTable:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str | T.StructType,
        key: Sequence[str] = (),
        day: str = "event_date",
        sort: Sequence[str] = (),
        mode: str = "write",
    ):
        if mode not in ("write", "read"):
            raise ValueError("mode is 'write' or 'read'")
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.key, self.day, self.sort, self.mode = list(key), day, list(sort), mode

    def with_session(self, spark: SparkSession) -> DayTable:
        """The same table seen from another session (a micro-batch has its own)."""
        return DayTable(spark, self.root, self.schema, self.key, self.day, self.sort, self.mode)

    # Published list

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _children(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        if not fs.exists(target):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(target))

    def _versions(self) -> list[int]:
        names = self._children(f"{self.root}/_published")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _list_path(self, version: int) -> str:
        return f"{self.root}/_published/{version:010d}.json"

    def _load(self, version: int) -> dict:
        fs, target = self._fs(self._list_path(version))
        stream = fs.open(target)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def state(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "base": {}, "deltas": [], "tokens": {}}
        return self._load(versions[-1])

    def _publish(self, state: dict, base=None, deltas=None, token: tuple[str, int] | None = None) -> None:
        version = state["version"] + 1
        new = {
            "version": version,
            "base": state["base"] if base is None else base,
            "deltas": state["deltas"] if deltas is None else deltas,
            "tokens": {**state["tokens"], **({token[0]: token[1]} if token else {})},
        }
        jvm = self.spark._jvm
        fs, draft = self._fs(f"{self.root}/_published/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        finally:
            stream.close()
        _, final = self._fs(self._list_path(version))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            final.toUri(), self.spark._jsc.hadoopConfiguration()
        )
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        try:
            files.rename(draft, final, options)
        except Exception as error:
            fs.delete(draft, False)
            raise Conflict(f"{self.root} version {version} exists") from error

    def already_done(self, token: tuple[str, int] | None) -> bool:
        """True if the named stream has published this batch number, or a later one."""
        return token is not None and self.state()["tokens"].get(token[0], -1) >= token[1]

    # Files

    def _new_commit(self, version: int) -> str:
        return f"{COMMIT}={version:010d}-{uuid.uuid4().hex[:8]}"

    def _write(self, rows: DataFrame, version: int) -> tuple[str, list[str]]:
        commit = self._new_commit(version)
        columns = [f.name for f in self.schema.fields]
        # REBALANCE puts a day's rows together, splits a day that is too big for one task and
        # merges small ones, so file sizes follow spark.sql.adaptive.advisoryPartitionSizeInBytes.
        placed = rows.select(*columns).hint("rebalance", self.day)
        if self.sort:
            placed = placed.sortWithinPartitions(self.day, *self.sort)
        placed.write.partitionBy(self.day).parquet(f"{self.root}/{commit}")
        prefix = f"{self.day}="
        days = [n[len(prefix) :] for n in self._children(f"{self.root}/{commit}") if n.startswith(prefix)]
        if NO_DAY in days:
            raise ValueError(f"rows without {self.day}")
        return commit, days

    def _write_delta(self, rows: DataFrame, version: int) -> str:
        commit = self._new_commit(version)
        columns = [f.name for f in self.schema.fields]
        dated = F.coalesce(self.day, F.raise_error(F.lit(f"rows without {self.day}")).cast("date"))
        placed = rows.select(*columns).withColumn(self.day, dated).hint("rebalance")
        placed.write.parquet(f"{self.root}/{commit}")
        return commit

    def _scan(self, paths: Iterable[str]) -> DataFrame:
        fields = [f for f in self.schema.fields if f.name != self.day]
        by_name = {f.name: f for f in self.schema.fields}
        parts = [T.StructField(COMMIT, T.StringType()), by_name[self.day]]
        full = T.StructType([*fields, *parts])
        paths = list(paths)
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.root).parquet(*paths)

    def _base(self, state: dict, days: Iterable[str] | None = None) -> DataFrame:
        wanted = state["base"] if days is None else [d for d in days if d in state["base"]]
        return self._scan(
            f"{self.root}/{c}/{self.day}={d}" for d in wanted for c in state["base"][d]
        )

    def _delta_rows(self, state: dict) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(COMMIT, T.StringType())])
        paths = [f"{self.root}/{c}" for c in state["deltas"]]
        return self.spark.read.schema(full).option("basePath", self.root).parquet(*paths)

    # Reading

    def days(self) -> list[str]:
        return sorted(self.state()["base"])

    def read(self, days: Iterable[str] | None = None, state: dict | None = None) -> DataFrame:
        """Current rows, or those of a state. ``days`` restricts the folders opened."""
        state = self.state() if state is None else state
        columns = [f.name for f in self.schema.fields]
        wanted = None if days is None else sorted(set(days))
        rows = self._base(state, wanted)
        if state["deltas"]:
            deltas = self._delta_rows(state)
            # A delta holds a key once, so the commit decides.
            newest = keep_latest_arrival(deltas, self.key, [COMMIT], unique=True)
            known = deltas.select(*self.key).distinct()
            rows = rows.join(known, self.key, "left_anti").unionByName(newest)
            if wanted is not None:
                rows = rows.where(F.col(self.day).cast("string").isin(wanted))
        return rows.select(*columns)

    # Changing

    def append(self, rows: DataFrame, token: tuple[str, int] | None = None) -> bool:
        """Add rows as they are. False if the token says it was done before."""
        if self.already_done(token):
            return False
        state = self.state()
        commit, days = self._write(rows, state["version"] + 1)
        base = {**state["base"], **{d: [*state["base"].get(d, []), commit] for d in days}}
        self._publish(state, base=base, token=token)
        return True

    def upsert(
        self, batch: DataFrame, arrival: Sequence[str], token: tuple[str, int] | None = None
    ) -> bool:
        """Insert rows; a row with a known key replaces the stored one, on whatever day that is."""
        if not self.key:
            raise ValueError("an upsert table needs a key")
        if self.already_done(token):
            return False
        newest = keep_latest_arrival(batch, self.key, arrival)
        state = self.state()
        if self.mode == "read":
            commit = self._write_delta(newest, state["version"] + 1)
            self._publish(state, deltas=[*state["deltas"], commit], token=token)
            return True
        newest = newest.persist()
        try:
            touched = self.days_of(newest) | self.days_with(newest.select(*self.key), self.key, state)
            columns = [f.name for f in self.schema.fields]
            stored = self.read(touched, state)
            replaced = stored.join(newest.select(*self.key), self.key, "left_anti")
            merged = replaced.unionByName(newest.select(*columns))
            self._replace(state, merged, touched, token)
        finally:
            newest.unpersist()
        return True

    def fold(self) -> list[str]:
        """Merge deltas into the days they touch. Returns those days."""
        state = self.state()
        if not state["deltas"]:
            return []
        deltas = self._delta_rows(state)
        known = deltas.select(*self.key).distinct()
        stored = _between_bounds(self._base(state), known, self.key).join(known, self.key, "left_semi")
        touched = self.days_of(deltas) | self.days_of(stored)
        self._replace(state, self.read(touched, state), touched, None, deltas=[])
        return sorted(touched)

    def rewrite(
        self,
        change: Callable[[DataFrame], DataFrame],
        touched: Iterable[str],
        token: tuple[str, int] | None = None,
    ) -> bool:
        """Replace the touched days by ``change(their rows)``; a day left without rows disappears."""
        if self.already_done(token):
            return False
        self.fold()
        touched = set(touched)
        if touched:
            state = self.state()
            if state["deltas"]:
                raise Conflict(f"{self.root}: rows arrived while it was being rewritten")
            self._replace(state, change(self.read(touched, state)), touched, token)
        return bool(touched)

    def _replace(self, state: dict, rows: DataFrame, touched: set[str], token, deltas=None) -> None:
        """Publish ``rows``, which were planned from ``state``, in place of the touched days.

        Only the version after ``state`` can be published, so a change made in between is a conflict.
        """
        commit, days = self._write(rows, state["version"] + 1)
        stray = set(days) - touched
        if stray:
            raise ValueError(f"rows for days that are not rewritten: {sorted(stray)}")
        base = {d: c for d, c in state["base"].items() if d not in touched}
        base.update({d: [commit] for d in days})
        self._publish(state, base=base, deltas=deltas, token=token)

    def drop_days(self, days: Iterable[str]) -> list[str]:
        """Remove whole days. No data is read, unless deltas have to be merged first."""
        self.fold()
        state = self.state()
        if state["deltas"]:
            raise Conflict(f"{self.root}: rows arrived while days were being dropped")
        gone = sorted(set(days) & set(state["base"]))
        if gone:
            self._publish(state, base={d: c for d, c in state["base"].items() if d not in gone})
        return gone

    def truncate(self) -> None:
        self._publish(self.state(), base={}, deltas=[])

    def vacuum(self, keep: int = 1, grace_seconds: float = GRACE_SECONDS) -> list[str]:
        """Delete folders that none of the newest ``keep`` published lists names.

        A folder that no list names at all may be one that somebody is writing just now. It is left
        alone until it is ``grace_seconds`` old.
        """
        versions = self._versions()
        every = {v: self._load(v) for v in versions}
        named = {c for s in every.values() for c in (*s["deltas"], *(c for cs in s["base"].values() for c in cs))}
        lists = [every[v] for v in versions[-keep:]]
        used = {(c, d) for s in lists for d, cs in s["base"].items() for c in cs}
        deltas = {c for s in lists for c in s["deltas"]}
        removed = []
        for commit in self._children(self.root):
            if not commit.startswith(f"{COMMIT}=") or commit in deltas:
                continue
            if commit not in named and self._age(commit) < grace_seconds:
                continue
            names = [n for n in self._children(f"{self.root}/{commit}") if n.startswith(f"{self.day}=")]
            keep_names = {n for n in names if (commit, n.split("=", 1)[1]) in used}
            targets = [f"{commit}/{n}" for n in names if n not in keep_names] if keep_names else [commit]
            for name in targets:
                fs, target = self._fs(f"{self.root}/{name}")
                fs.delete(target, True)
                removed.append(name)
        for version in versions[:-keep]:
            fs, target = self._fs(self._list_path(version))
            fs.delete(target, False)
        return removed

    def _age(self, commit: str) -> float:
        fs, target = self._fs(f"{self.root}/{commit}")
        return time.time() - fs.getFileStatus(target).getModificationTime() / 1000

    # Which days

    def days_of(self, rows: DataFrame) -> set[str]:
        """Distinct days of the rows; at most one entry per day of the calendar."""
        found = rows.select(F.col(self.day).cast("string").alias("d")).distinct().collect()
        return {r["d"] for r in found}

    def days_with(self, ids: DataFrame, on: Sequence[str], state: dict | None = None) -> set[str]:
        """Days that hold a row matching ``ids``; reads only the id and day columns.

        A short list of ids goes into the scan as a filter: with files sorted by the id, row groups
        without any of them are skipped. A longer list is joined.
        """
        if len(on) == 1:
            few = [r[0] for r in ids.select(*on).limit(FEW_IDS + 1).collect()]
            if len(few) <= FEW_IDS:
                return self.days_of(self.read(None, state).where(F.col(on[0]).isin(few))) if few else set()
        found = _between_bounds(self.read(None, state), ids, on).join(ids, list(on), "left_semi")
        return self.days_of(found)

    def segments(self, days: Iterable[str] | None = None) -> list[tuple[str, str, int, int]]:
        """Day, commit, bytes and files of the current folders, from file metadata."""
        state, out = self.state(), []
        for day in sorted(state["base"] if days is None else set(days) & set(state["base"])):
            for commit in state["base"][day]:
                fs, target = self._fs(f"{self.root}/{commit}/{self.day}={day}")
                summary = fs.getContentSummary(target)
                out.append((day, commit, summary.getLength(), summary.getFileCount()))
        return out

    def sizes(self) -> list[tuple[str, int, int]]:
        """Day, bytes and files."""
        totals: dict[str, list[int]] = {}
        for day, _, size, files in self.segments():
            total = totals.setdefault(day, [0, 0])
            total[0], total[1] = total[0] + size, total[1] + files
        return [(day, size, files) for day, (size, files) in totals.items()]

    def lists_since(self, seconds: float) -> int:
        """How many of the newest lists were published in the last ``seconds``; one at least."""
        fs, target = self._fs(f"{self.root}/_published")
        born = (time.time() - seconds) * 1000
        return max(1, sum(s.getModificationTime() >= born for s in fs.listStatus(target)))

    def holds_files(self) -> bool:
        """True if any folder of rows, current or not, is there."""
        return any(c.startswith(f"{COMMIT}=") for c in self._children(self.root))

    def most_segments(self) -> int:
        return max((len(c) for c in self.state()["base"].values()), default=0)

    def merge_segments(self, chosen: dict[str, list[str]]) -> None:
        """Rewrite the chosen folders of each day into one; the others stay as they are."""
        state = self.state()
        if any(not set(cs) <= set(state["base"].get(d, [])) for d, cs in chosen.items()):
            raise Conflict(f"{self.root}: a chosen folder is no longer current")
        paths = [f"{self.root}/{c}/{self.day}={d}" for d, cs in chosen.items() for c in cs]
        commit, days = self._write(self._scan(paths), state["version"] + 1)
        base = dict(state["base"])
        for day, commits in chosen.items():
            base[day] = [*[c for c in base[day] if c not in commits], *([commit] if day in days else [])]
        self._publish(state, base=base)
