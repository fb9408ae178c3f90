"""Streams with keyed state against the batch forms of the same."""

import os
import random
from datetime import UTC, datetime

import pytest

from stowage import schemas
from stowage.plans import trend
from stowage.streaming import states

T0 = 1_767_225_600  # 2026-01-01


def event(scan, seq, phase, at, files=0, bytes_=0, errors=0):
    return seq, scan, phase, None, files, bytes_, errors, None if at is None else datetime.fromtimestamp(T0 + at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def streamed(spark, tmp_path, batches, timeout_ms=60_000, late="10 seconds"):
    """Final states of a stream that gets one file a batch."""
    folder = tmp_path / "events"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schemas.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/one{k}")
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"one{k}").glob("part-*.parquet"))
        part.rename(folder / f"{k:03}.parquet")
        os.utime(folder / f"{k:03}.parquet", (T0 + k, T0 + k))  # files are taken by their age
    own = states.stream_session(spark)
    states.drained(states.session_changes(states.event_stream(own, str(folder)), timeout_ms, late), f"{tmp_path}/log", f"{tmp_path}/check")
    return states.latest(spark.read.schema(states.SESSION).parquet(f"{tmp_path}/log"), "scan_id")


def of(df):
    cols = ("scan_id", "status", "phase", "seq", "events", "scanned_files", "scanned_bytes", "errors", "last_ms")
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_session_states_of_a_stream(spark, tmp_path):
    a = [event("a", k, p, 2 * k, 10 * k, 100 * k) for k, p in enumerate(schemas.PHASES, 1)]
    b = [event("b", 1, "enumerating_disks", 1), event("b", 2, "walking_files", 4, 7, 70, 1)]  # falls silent
    c = [event("c", 1, "walking_files", 3), event("c", 2, "failed", 5, 1, 1, 2)]
    d = [event("d", 1, "walking_files", 150), event("d", 2, "cancelled", 160)]
    e = [event("e", 1, "walking_files", 161), event("e", 3, "dedupe", 170), event("e", 2, "categorizing", 165), event("e", 4, "analyzing", None)]  # without a time
    batches = [[a[0], b[0], c[0], a[3]], [*a[1:3], b[1], *c[1:], *a[4:]], d, e]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = of(streamed(spark, tmp_path, batches))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    status = {r[0]: (r[1], r[2], r[4]) for r in got}
    assert status == {"a": ("completed", "done", 7), "b": ("timed_out", "walking_files", 2), "c": ("failed", "failed", 2), "d": ("cancelled", "cancelled", 2), "e": ("running", "dedupe", 3)}
    every = spark.createDataFrame([x for rows in batches for x in rows], schemas.EVENT_SCHEMA)
    assert got == of(states.session_states(every, 60_000, 10_000))


def test_late_events_are_left_out_and_a_scan_comes_back(spark, tmp_path):
    batches = [[event("x", 1, "walking_files", 0), event("y", 1, "walking_files", 0)], [event("z", 1, "walking_files", 100)], [event("z", 2, "walking_files", 101)],
               [event("y", 2, "done", 50), event("x", 2, "categorizing", 120)]]  # y's end is behind the watermark of 91
    got = {r[0]: r[1:3] for r in of(streamed(spark, tmp_path, batches))}
    assert got == {"x": ("running", "categorizing"), "y": ("timed_out", "walking_files"), "z": ("running", "walking_files")}
    log = spark.read.schema(states.SESSION).parquet(f"{tmp_path}/log")
    assert [r["status"] for r in log.where("scan_id = 'x'").orderBy("version").collect()] == ["running", "timed_out", "running"]


@pytest.mark.parametrize("order", ["as it was", "backwards", "mixed"])
def test_growth_of_a_stream_equals_the_batch_form(spark, tmp_path, order):
    r, gib = random.Random(3), 1 << 30
    snaps = []
    for k in range(6):
        for m in "abcde":
            if (m, k) not in (("c", 5), ("d", 4)):  # c is not in the last one, d not in the one before
                snaps.append((k, f"2026-01-{1 + k:02}T00:00:00Z", f"/{m}", f"/{m}", 100 * gib, r.randrange(0, 100) * gib, r.randrange(1, 60) * gib))
    df = spark.createDataFrame(snaps, "snap_pos int, generated_at string, mount_point string, root_path string, total_space_bytes bigint, free_space_bytes bigint, total_size_bytes bigint")
    rows = states.snapshot_rows(df, df).collect()
    rows += rows[:7]  # some come again
    if order != "as it was":
        rows = rows[::-1] if order == "backwards" else r.sample(rows, len(rows))
    folder = tmp_path / "snaps"
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k:k + 40], states.SNAPSHOT).coalesce(1).write.mode("append").parquet(str(folder))
    own = states.stream_session(spark)
    stream = own.readStream.schema(states.SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(str(folder))
    states.drained(states.growth_changes(stream), f"{tmp_path}/log", f"{tmp_path}/check")
    disk, path = states.growth_of(states.latest(spark.read.schema(states.GROWTH).parquet(f"{tmp_path}/log"), "series", "kind", "name"))
    plain = lambda x: sorted(map(tuple, x.collect()))
    assert plain(disk) == plain(trend.disk_growth(df)) and plain(path) == plain(trend.path_growth(df))
    assert plain(path.unionByName(disk.withColumnRenamed("mount_point", "root_path"))) and "c" not in {x["root_path"][1:] for x in path.collect()}


def test_snapshots_fold_in_any_order():
    snaps = [(k, f"t{k}", 10 * k, 0) for k in range(5)]
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 4, 0, 3, 1], [4, 4, 3]):
        state = None
        for k in order:
            state = states.fold_snapshots(state, [snaps[k]])
        assert state == (4, "t4", 40, 0, 3, "t3", 30)
    assert states.fold_snapshots(None, snaps[:1]) == (0, "t0", 0, 0, None, None, None)


def test_states_of_no_events(spark):
    none = spark.createDataFrame([], schemas.EVENT_SCHEMA)
    assert states.session_states(none).count() == 0 and states.with_times(none).count() == 0
    assert states.latest(spark.createDataFrame([], states.GROWTH), "series", "kind", "name").count() == 0
