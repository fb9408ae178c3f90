"""Keyed state over streams: scan sessions with time-outs, and growth from a stream of snapshots.

Both run on transformWithState.  What leaves a query is a change log, appended to a table: one row for each key and batch
that changed it, with a version that counts up; latest() is the table's present.  The state store with timers is set in
a session of its own, so the caller's settings stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..plans import trend
from ..tables import importable

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNNING, COMPLETED, CANCELLED, FAILED, TIMED_OUT = "running", "completed", "cancelled", "failed", "timed_out"
#: Phases that end a scan.  The first five of schemas.PHASES and `recommending` keep it running.
ENDS = {"done": COMPLETED, "cancelled": CANCELLED, "failed": FAILED}
#: A scan without events for so long, by event time, has timed out; events may come so late.
TIMEOUT_MS, LATE = 600_000, "1 minute"

SESSION = "scan_id string, status string, phase string, seq bigint, events bigint, scanned_files bigint, scanned_bytes bigint, errors bigint, last_ms bigint, version bigint"
SNAPSHOT = "series string, kind string, name string, snap_pos bigint, generated_at string, size_bytes bigint, total_bytes bigint"
GROWTH = ("series string, kind string, name string, snap_pos bigint, generated_at string, size_bytes bigint, total_bytes bigint, "
          "previous_pos bigint, previous_at string, previous_bytes bigint, version bigint")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with the state store that timers need, beside the caller's."""
    importable(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    return own


def fold_session(state: dict | None, events: pd.DataFrame) -> dict:
    """A scan's state after some of its events, in whatever order they come: the last by seq says the phase, and an end
    that was seen stays."""
    s = dict(state or {"status": RUNNING, "phase": None, "seq": -1, "events": 0, "scanned_files": 0, "scanned_bytes": 0, "errors": 0, "last_ms": 0, "version": 0})
    s["events"] += len(events)
    s["last_ms"] = max(s["last_ms"], int(events["ms"].max()))
    for c in ("scanned_files", "scanned_bytes", "errors"):
        s[c] = max(s[c], int(events[c].max()))
    last = events.loc[events["seq"].idxmax()]
    if last["seq"] > s["seq"]:
        s["seq"], s["phase"] = int(last["seq"]), last["phase"]
    ended = [ENDS[p] for p in events.sort_values("seq")["phase"] if p in ENDS]
    if ended or s["status"] in (RUNNING, TIMED_OUT):
        s["status"] = ended[-1] if ended else RUNNING
    s["version"] += 1
    return s


class SessionState(StatefulProcessor):
    """One value a scan, and one timer while it runs: TIMEOUT_MS after its last event."""

    FIELDS = SESSION.split(", ", 1)[1]

    def __init__(self, timeout_ms: int = TIMEOUT_MS):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", self.FIELDS)
        self.names = [f.split()[0] for f in self.FIELDS.split(", ")]

    def _get(self) -> dict | None:
        return dict(zip(self.names, self.state.get(), strict=True)) if self.state.exists() else None

    def _put(self, key, s: dict) -> Iterator[pd.DataFrame]:
        self.state.update(tuple(s[n] for n in self.names))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s["status"] == RUNNING:
            self.handle.registerTimer(s["last_ms"] + self.timeout_ms)
        yield pd.DataFrame([{"scan_id": key[0], **s}])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        yield from self._put(key, fold_session(self._get(), batch))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._get()
        if s and s["status"] == RUNNING:
            yield from self._put(key, s | {"status": TIMED_OUT, "version": s["version"] + 1})

    def close(self) -> None:
        pass


def with_times(events: DataFrame) -> DataFrame:
    """Events with ts and ms of their timestamp; rows whose timestamp or seq can't be read are left out."""
    rows = events.withColumn("ts", F.try_to_timestamp("timestamp")).where(F.col("ts").isNotNull() & F.col("seq").isNotNull())
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("scanned_files", "scanned_bytes", "errors")}
    return rows.withColumns({"ms": F.unix_millis("ts"), **zero}).select("scan_id", "seq", "phase", "ts", "ms", *zero)


def session_changes(events: DataFrame, timeout_ms: int = TIMEOUT_MS, late: str = LATE) -> DataFrame:
    """The change log of scan states of a stream of events (EVENT_SCHEMA): events behind the watermark are left out, and a
    scan whose last event is older than the watermark by the time-out is timed out (a later event takes it up again)."""
    rows = with_times(events).withWatermark("ts", late)
    return rows.groupBy("scan_id").transformWithStateInPandas(SessionState(timeout_ms), SESSION, "Append", "EventTime")


def session_states(events: DataFrame, timeout_ms: int = TIMEOUT_MS, late_ms: int = 60_000) -> DataFrame:
    """The same states from a table of all events, none of them late."""
    rows = with_times(events)
    ends = F.when(F.col("phase").isin(*ENDS), F.struct("seq", "phase"))
    out = rows.groupBy("scan_id").agg(
        F.max(ends).alias("_end"), F.max_by("phase", "seq").alias("phase"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("events"),
        *(F.max(c).alias(c) for c in ("scanned_files", "scanned_bytes", "errors")), F.max("ms").alias("last_ms"))
    mark = rows.agg((F.max("ms") - late_ms).alias("_mark"))
    status = F.lit(None).cast("string")
    for phase, name in ENDS.items():
        status = F.when(F.col("_end.phase") == phase, name).otherwise(status)
    status = F.coalesce(status, F.when(F.col("last_ms") + timeout_ms <= F.col("_mark"), TIMED_OUT).otherwise(RUNNING))
    return out.crossJoin(F.broadcast(mark)).withColumn("status", status).drop("_end", "_mark")  # one row


def fold_snapshots(state: tuple | None, rows: list[tuple]) -> tuple:
    """(pos, at, size, total, previous pos, at, size) of the last two snapshots of a key, in whatever order they come; a
    snapshot that comes again replaces itself."""
    last = {}
    if state:
        last[state[0]] = state[:4]
        if state[4] is not None:
            last[state[4]] = (*state[4:7], None)
    last |= {r[0]: r for r in rows}
    two = sorted(last, reverse=True)[:2]
    before = last[two[1]][:3] if len(two) > 1 else (None, None, None)
    return (*last[two[0]], *before)


class GrowthState(StatefulProcessor):
    """The last two snapshots of a disk or root."""

    FIELDS = GROWTH.split(", ", 3)[3]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last_two", self.FIELDS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        got = [(int(p), at, int(size), int(total)) for p, at, size, total in zip(batch["snap_pos"], batch["generated_at"], batch["size_bytes"], batch["total_bytes"], strict=True)]
        old = tuple(self.state.get()) if self.state.exists() else None
        new = (*fold_snapshots(old[:7] if old else None, got), (old[7] if old else 0) + 1)
        self.state.update(new)
        out = pd.DataFrame([(*key, *new)], columns=[f.split()[0] for f in GROWTH.split(", ")])
        yield out.astype({"previous_pos": "Int64", "previous_bytes": "Int64"})

    def close(self) -> None:
        pass


def snapshot_rows(disks: DataFrame, paths: DataFrame, series: str = "") -> DataFrame:
    """Snapshots as trend has them as rows of SNAPSHOT: of disks, of roots, and of the snapshots themselves, which say what
    the last two are.  Works on tables and on streams."""
    one = F.lit(series).alias("series")
    rows = lambda df, kind, name, size, total: df.select(one, F.lit(kind).alias("kind"), name.alias("name"), F.col("snap_pos").cast("bigint").alias("snap_pos"), "generated_at",
                                                         size.cast("bigint").alias("size_bytes"), total.cast("bigint").alias("total_bytes"))
    none = F.lit(0)
    return (rows(disks, "disk", F.col("mount_point"), F.col("free_space_bytes"), F.col("total_space_bytes")).unionByName(rows(paths, "path", F.col("root_path"), F.col("total_size_bytes"), none))
            .unionByName(rows(disks, "disks", F.lit(""), none, none)).unionByName(rows(paths, "paths", F.lit(""), none, none)))


def growth_changes(snapshots: DataFrame) -> DataFrame:
    """The change log of the last two snapshots of each key of a stream of SNAPSHOT rows."""
    return snapshots.groupBy("series", "kind", "name").transformWithStateInPandas(GrowthState(), GROWTH, "Append", "None")


def growth_of(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What trend.disk_growth and trend.path_growth find, from the present states: keys whose last two snapshots are the
    last two of their series."""
    def both(kind: str) -> DataFrame:
        last = states.where(F.col("kind") == f"{kind}s").select("series", "snap_pos", "previous_pos")
        return states.where(F.col("kind") == kind).join(last, ["series", "snap_pos", "previous_pos"])

    disk = both("disk").select("series", F.col("name").alias("mount_point"), F.col("size_bytes").alias("free_space_bytes"), F.col("total_bytes").alias("total_space_bytes"), "generated_at",
                               F.col("previous_bytes").alias("previous_free_space_bytes"), F.col("previous_at").alias("previous_generated_at"))
    path = both("path").select("series", F.col("name").alias("root_path"), F.col("size_bytes").alias("total_size_bytes"), "generated_at",
                               F.col("previous_bytes").alias("previous_total_size_bytes"), F.col("previous_at").alias("previous_generated_at"))
    return trend.grown_disks(disk), trend.grown_paths(path)


def drained(changes: DataFrame, table: str, checkpoint: str, seconds: int = 600) -> None:
    """Runs a change log's query over what its source has now, appending to a table."""
    q = changes.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(seconds):
            raise TimeoutError(f"the stream took more than {seconds} seconds")
    finally:
        q.stop()


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """The present of a change log: of each key the row of the highest version."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_s")).select(*keys, "_s.*")


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
