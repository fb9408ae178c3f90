"""Walks that commit what they read: parts, slices, cancelled and lost walks, counters of running tasks."""

import json
import os
import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from stowage import service
from stowage.sources import devices, filetree, walk
from stowage.streaming.sessions import Cancelled, Sessions
from stowage.tables import Commits

GIB = 1 << 30
PROBE = devices.PROBE.replace("pos int", "scan_id string, pos int")


def grow(folder, dirs, files, deep=2):
    for i in range(dirs):
        p = folder / f"d{i}" / "/".join("x" * deep)
        p.mkdir(parents=True)
        for k in range(files):
            (p / f"f{k}").write_text("x" * (k + 1))
    return str(folder)


def kinds(df):
    return sorted((r["path"], r["kind"], r["size_bytes"], r["modified_ts"]) for r in df.collect())


@pytest.fixture
def probes(spark):
    return spark.createDataFrame([("s", 0, "disk", "/", 100 * GIB, 50 * GIB, "ssd", "ext4", False)], PROBE)


@pytest.fixture
def hints(spark):
    return spark.createDataFrame([], devices.HINT)


def test_commits_count_once_they_are_over(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "t"), "x int")
    assert c.names() == [] and c.read().count() == 0
    one = spark.createDataFrame([(1,), (2,)], "x int")
    c.append(one, "a")
    one.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/t/lost")
    assert c.names() == ["a"] and sorted(r[0] for r in c.read().collect()) == [1, 2]
    c.append(one.where("x = 2"), "a")
    c.append(one, "lost")
    assert c.names() == ["a", "lost"] and c.read().count() == 3 and c.read(["a"]).count() == 1
    c.remove()
    assert c.names() == []


@pytest.mark.parametrize("depth", [None, 1, 2, 4])
def test_walk_equals_the_plain_source(spark, tmp_path, monkeypatch, depth):
    roots = [grow(tmp_path / "a", 7, 3), grow(tmp_path / "b", 2, 1), str(tmp_path / "none")]
    (tmp_path / "a" / "skip.tmp").write_text("t")
    os.symlink(roots[1], tmp_path / "a" / "link")
    monkeypatch.setattr(walk, "ENTRIES", (3, 5))  # many rounds
    w = walk.Walk(spark, str(tmp_path / "w"), roots, depth, ["*.tmp"])
    w.run()
    assert kinds(w.tree()) == kinds(filetree.read_tree(spark, roots, depth, ["*.tmp"])) and w.begun() == roots
    assert len(w.table.names()) > 3 or depth == 1


def test_a_flat_directory_is_walked_in_slices(spark, tmp_path, monkeypatch):
    root = grow(tmp_path / "flat", 1, 40, 0)
    monkeypatch.setattr(walk, "FLAT", 9)
    rows = list(walk.walk_rows(walk.deque([(root + "/d0", root + "/d0", 0, 0, 1)]), 100, None, filetree.Excludes([])))
    assert [(r[2], r[8], r[9]) for r in rows] == [(walk.DEFERRED, k, 5) for k in range(5)]
    parts = [list(walk.walk_rows(walk.deque([(root, root + "/d0", 1, k, 5)]), 100, None, filetree.Excludes([]))) for k in range(5)]
    assert sorted(r[1] for p in parts for r in p) == sorted(f"{root}/d0/f{k}" for k in range(40)) and all(1 < len(p) < 20 for p in parts)
    assert {zlib.crc32(b"f0") % 5} == {k for k, p in enumerate(parts) if any(r[1].endswith("/f0") for r in p)}


def test_names_that_are_no_text_are_warnings(tmp_path):
    os.mkdir(tmp_path / "r")
    open(os.fsencode(str(tmp_path / "r")) + b"/\xff", "w").close()
    (tmp_path / "r" / "ok").write_text("")
    rows = list(walk.walk_rows(walk.deque([("r", str(tmp_path / "r"), 0, 0, 1)]), 100, None, filetree.Excludes([])))
    assert [(r[2], os.path.basename(r[1])) for r in rows] == [("file", "ok"), ("warning", "�")]


def test_a_lost_walk_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    roots = [grow(tmp_path / n, 4, 2) for n in ("a", "b", "c")]
    monkeypatch.setattr(walk, "ENTRIES", (2, 4))
    w = walk.Walk(spark, str(tmp_path / "w"), roots)

    def stop(root, *seen):
        if root == roots[1]:
            raise OSError("lost")

    with pytest.raises(OSError):
        w.run(stop)
    before = {n: os.stat(f"{w.table.folder}/{n}/_SUCCESS").st_mtime_ns for n in w.table.names()}
    assert w.begun() == roots[:2] and before
    seen = []
    again = walk.Walk(spark, str(tmp_path / "w"), roots)
    again.run(lambda root, *n: seen.append((root, *n)))
    assert kinds(again.tree()) == kinds(filetree.read_tree(spark, roots)) and seen[-1][1:3] == (24, 36)
    assert all(os.stat(f"{w.table.folder}/{n}/_SUCCESS").st_mtime_ns == t for n, t in before.items())  # nothing was read twice
    assert walk.Walk(spark, str(tmp_path / "w"), roots, 3).begun() == []  # other limits are another walk


def test_counters_grow_while_the_job_runs(spark, tmp_path, monkeypatch):
    root = grow(tmp_path / "a", 24, 5, 0)
    monkeypatch.setattr(walk, "ENTRIES", (24, 5))
    slow = walk.entries_of
    monkeypatch.setattr(walk, "_task", lambda batches, *a, f=walk._task: (time.sleep(0.15) or b for b in f(batches, *a)))
    assert slow is walk.entries_of
    w, ticks = walk.Walk(spark, str(tmp_path / "w"), [root]), []
    w.run(on_tick=lambda r, *seen: ticks.append((*seen, len(w.table.names()))), interval_ms=20)
    files = [t[0] for t in ticks]
    assert len(files) >= 2 and files == sorted(files) and 0 < files[0] < 120 and ticks[0][3] == 1  # told before the second commit
    few = []
    walk.Walk(spark, str(tmp_path / "w2"), [root]).run(on_tick=lambda r, *seen: few.append(seen), interval_ms=60_000)
    assert few == []


def test_a_cancelled_scan_reports_the_roots_it_has(spark, tmp_path, probes, hints):
    roots = [grow(tmp_path / n, k, 2) for n, k in (("a", 3), ("b", 4), ("c", 5))]
    stop = []

    def on_event(e):
        if e["current_path"] == roots[1]:
            stop.append(e)
            raise Cancelled

    opts = service.ScanOptions(roots=roots, cache=True)
    r = service.scan(spark, opts, str(tmp_path / "s"), on_event, probes, hints, "cut", cancelled=lambda: bool(stop))
    whole = service.scan(spark, service.ScanOptions(roots=roots), None, None, probes, hints)
    assert [p["root_path"] for p in r["paths"]] == roots[:2] and r["paths"] == whole["paths"][:2]
    assert r["paths"][1]["file_count"] == 8 and r["paths"][1]["largest_files"]["entries"] and r["paths"][0]["disk_mount"] == "/"
    assert r["scan_metrics"]["scanned_files"] == 14 and not r["scan_progress_summary"]["completed"]
    assert f"scan canceled while walking {roots[1]}; report contains partial data" in r["warnings"] and "scan canceled by caller" in r["warnings"]
    assert not os.path.exists(tmp_path / "s" / "history.json") and not os.listdir(tmp_path / "s" / "cache") if os.path.exists(tmp_path / "s" / "cache") else True


def test_a_session_that_is_cancelled_between_roots(spark, tmp_path, probes, hints):
    roots = [grow(tmp_path / n, 3, 2) for n in ("a", "b", "c")]
    sessions, at_b = Sessions(spark), threading.Event()

    def work(scan_id, emit, cancelled):
        def on_event(e):
            if e["current_path"] == roots[1]:
                at_b.set()
                while not cancelled():
                    time.sleep(0.01)
            emit(e)

        return service.scan(spark, service.ScanOptions(roots=roots), None, on_event, probes, hints, scan_id, cancelled)

    k = sessions.start(work)
    assert at_b.wait(60) and sessions.cancel(k)
    s = sessions.wait(k)
    assert s["status"] == "cancelled" and [p["root_path"] for p in s["report"]["paths"]] == roots[:2]


def test_a_failed_scan_is_taken_up_again(spark, tmp_path, probes, hints, monkeypatch):
    roots = [grow(tmp_path / n, 3, 2) for n in ("a", "b")]
    opts = service.ScanOptions(roots=roots)

    def lost(e):
        if e["phase"] == "categorizing":
            raise OSError("driver lost")

    with pytest.raises(OSError):
        service.scan(spark, opts, None, lost, probes, hints, "again")
    monkeypatch.setattr(walk.Walk, "_round", lambda *a: pytest.fail("walked again"))
    r = service.scan(spark, opts, None, None, probes, hints, "again")
    assert r["scan_metrics"]["scanned_files"] == 12 and r["scan_progress_summary"]["completed"]
    assert json.loads(json.dumps(r, default=str))["paths"][1]["root_path"] == roots[1]


def test_the_walked_tree_is_removed(spark, tmp_path, probes, hints):
    from stowage.tables import shared_folder

    service.scan(spark, service.ScanOptions(roots=[grow(tmp_path / "a", 1, 1)]), None, None, probes, hints, "gone")
    assert not any("gone" in n for n in os.listdir(shared_folder(spark)) if os.listdir(f"{shared_folder(spark)}/{n}"))


def test_partly_committed_rows_are_not_read(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "t"), walk.ROW)
    w = walk.Walk(spark, str(tmp_path), [grow(tmp_path / "a", 2, 1)])
    w.run()
    w.tree().withColumns({"depth": F.lit(0), "slice": F.lit(0), "slices": F.lit(1)}).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{c.folder}/x")
    assert c.read().count() == 0
