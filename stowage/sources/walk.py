"""A walk of file trees that keeps what it has read, tells how far it is, and splits itself.

Roots are walked in their order.  A root is walked in rounds: the tasks of a round get directories, walk them breadth
first, and hand back what is left when they have seen enough entries, as rows of kind `deferred`; these are the
directories of the next round.  Early rounds hand back soon, so one root becomes many tasks' work, and a subtree that is
larger than others does not stay with one task.  A directory with more than FLAT entries is handed back in slices, each
of which lists it and looks at its own share of the names.  Nothing of a tree passes the driver.

Each round is a commit of a table (tables.Commits).  A walk that is cancelled or lost keeps the rounds that were
committed, and a walk over the same folder goes on from there.  While a round runs, its tasks' counters reach the driver
as tasks end, and are told every interval.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
import threading
import zlib
from collections import deque
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Excludes
from ..tables import Commits, importable, local_table
from .filetree import SCHEMA

DEFERRED = "deferred"
ROW = f"{SCHEMA}, depth int, slice int, slices int"
#: Entries that a task looks at before it hands back the rest: by round, the last for all later rounds.
ENTRIES = (1000, 20_000, 500_000)
#: Entries of one directory that one task looks at; rows of a batch that a task sends on.
FLAT, BATCH = 200_000, 10_000


class Told:
    """Counters of a round that its tasks add to when they end: files, bytes, errors, tasks."""

    def __init__(self, sc):
        self.files, self.bytes, self.errors, self.tasks = (sc.accumulator(0) for _ in range(4))

    def add(self, files: int, bytes_: int, errors: int) -> None:
        self.files += files
        self.bytes += bytes_
        self.errors += errors
        self.tasks += 1

    def values(self) -> tuple[int, int, int]:
        return self.files.value, self.bytes.value, self.errors.value


def entries_of(folder: str, part: int, parts: int) -> list[os.DirEntry]:
    with os.scandir(folder) as found:
        return sorted((e for e in found if parts == 1 or zlib.crc32(os.fsencode(e.name)) % parts == part), key=lambda e: e.name)


def walk_rows(queue: deque, budget: int, max_depth: int | None, skip: Excludes):
    """Rows of ROW for the directories in queue, (root, folder, depth, slice, slices) each, and those found in them."""
    while queue:
        root, folder, depth, part, parts = queue.popleft()
        if max_depth is not None and depth >= max_depth:
            continue
        if budget <= 0:
            yield root, folder, DEFERRED, None, None, None, None, depth, part, parts
            continue
        try:
            entries = entries_of(folder, part, parts)
        except OSError as e:
            yield root, folder, "warning", None, None, None, str(e), depth, None, None
            continue
        if parts == 1 and len(entries) > FLAT:
            n = -(-len(entries) // FLAT)
            yield from ((root, folder, DEFERRED, None, None, None, None, depth, k, n) for k in range(n))
            continue
        budget -= len(entries) + 1
        for e in entries:
            path = e.path
            if skip.matches(path):
                continue
            try:
                path.encode()
                s = e.stat(follow_symlinks=False)
            except UnicodeEncodeError:
                yield root, os.fsencode(path).decode("utf-8", "replace"), "warning", None, None, None, "the name is not UTF-8", depth, None, None
                continue
            except OSError as error:
                yield root, path, "warning", None, None, None, str(error), depth, None, None
                continue
            if stat.S_ISDIR(s.st_mode):
                yield root, path, "directory", None, None, None, None, depth, None, None
                queue.append((root, path, depth + 1, 0, 1))
            elif stat.S_ISREG(s.st_mode):
                yield root, path, "file", s.st_size, datetime.fromtimestamp(int(s.st_mtime), UTC), None, None, depth, None, None


def _task(batches, budget: int, max_depth: int | None, excludes: list[str], told: Told):
    """One task of a round: all its directories share its budget."""
    import pyarrow as pa

    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in ROW.split(", ")]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    queue: deque = deque()
    for batch in batches:
        queue.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    files = bytes_ = errors = 0
    rows = []
    for row in walk_rows(queue, budget, max_depth, Excludes(excludes)):
        rows.append(row)
        files += row[2] == "file"
        bytes_ += row[3] or 0
        errors += row[2] == "warning"
        if len(rows) == BATCH:
            yield out(rows)
            rows = []
    if rows:
        yield out(rows)
    told.add(files, bytes_, errors)


class Walk:
    """roots: as given; on_tick(root, files, bytes, errors) is called while a round runs, each interval in which tasks
    ended, with what the walk has seen so far; on_root the same once a root is over.  A call that raises ends the walk."""

    def __init__(self, spark: SparkSession, folder: str, roots: list[str], max_depth: int | None = None, excludes=()):
        self.spark, self.roots, self.max_depth, self.excludes = spark, [os.path.abspath(r) for r in roots], max_depth, list(excludes)
        what = hashlib.sha256(json.dumps([self.roots, max_depth, self.excludes]).encode()).hexdigest()[:16]
        self.table = Commits(spark, f"{folder}/walk-{what}", ROW)  # another walk is another folder
        self.at: str | None = None
        importable(spark)

    @staticmethod
    def _name(root: int, round_: int) -> str:
        return f"root-{root:05}-{round_:05}"

    def _rounds(self) -> dict[int, int]:
        """Committed rounds by root."""
        out: dict[int, int] = {}
        for n in self.table.names():
            root = int(n.split("-")[1])
            out[root] = out.get(root, 0) + 1
        return out

    def _frontier(self, root: int, round_: int) -> DataFrame:
        """root_path, path, depth, slice, slices of the directories that a round walks."""
        if round_ == 0:
            return local_table(self.spark, [(self.roots[root], self.roots[root], 0, 0, 1)], "root_path string, path string, depth int, slice int, slices int")
        return self.table.read([self._name(root, round_ - 1)]).where(F.col("kind") == DEFERRED).select("root_path", "path", "depth", "slice", "slices")

    def _seen(self) -> tuple[int, int, int]:
        """What is committed, where there is some."""
        if not self.table.names():
            return 0, 0, 0
        r = self.tree().agg(F.count_if(F.col("kind") == "file"), F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count_if(F.col("kind") == "warning")).first()
        return r[0], r[1], r[2]

    def run(self, on_root: Callable | None = None, on_tick: Callable | None = None, interval_ms: int = 250) -> None:
        """Walks what is not committed yet."""
        done, seen = self._rounds(), self._seen()
        for k, root in enumerate(self.roots):
            self.at, round_ = root, done.get(k, 0)
            many = self.spark.sparkContext.defaultParallelism * 4
            while n := 1 if round_ == 0 else self._frontier(k, round_).limit(many).count():
                budget = ENTRIES[min(round_, len(ENTRIES) - 1)]
                seen = self._round(k, round_, n, budget, seen, on_tick, interval_ms)
                round_ += 1
            if on_root:
                on_root(root, *seen)
        self.at = None

    def _round(self, root: int, round_: int, tasks: int, budget: int, seen, on_tick, interval_ms: int) -> tuple[int, int, int]:
        told, max_depth, excludes = Told(self.spark.sparkContext), self.max_depth, self.excludes
        rows = self._frontier(root, round_).repartition(tasks).mapInArrow(lambda b: _task(b, budget, max_depth, excludes, told), ROW)
        now = lambda: tuple(a + b for a, b in zip(seen, told.values(), strict=True))
        over, failed, last = threading.Event(), [], [0]

        def tick() -> None:
            while not over.wait(interval_ms / 1000):
                ended = told.tasks.value
                if last[0] < ended < tasks:  # tasks ended, and others still run
                    last[0] = ended
                    try:
                        on_tick(self.roots[root], *now())
                    except BaseException as e:  # the caller wants to end: its jobs go
                        failed.append(e)
                        self.spark.interruptTag(tag)
                        return

        tag = f"walk-{id(told)}"
        watch = threading.Thread(target=tick, daemon=True) if on_tick and tasks > 1 else None
        self.spark.addTag(tag)
        try:
            if watch:
                watch.start()
            self.table.append(rows, self._name(root, round_))
        finally:
            over.set()
            self.spark.removeTag(tag)
            if watch:
                watch.join()
            if failed:
                raise failed[0]
        return now()

    def tree(self) -> DataFrame:
        """Committed rows, of the schema of filetree."""
        return self.table.read().where(F.col("kind") != DEFERRED).select(*(c.split()[0] for c in SCHEMA.split(", ")))

    def begun(self) -> list[str]:
        """The roots that have a committed round."""
        return [self.roots[k] for k in sorted(self._rounds())]

    def remove(self) -> None:
        self.table.remove()
