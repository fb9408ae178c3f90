"""The store as a table: replacement, removal, two writers at once, puts that were lost."""

import threading

from pyspark.sql import functions as F

from stowage.sinks import ReportTable
from stowage.sources import documents

from .test_reports import disk, report


def made(spark, *reports):
    return documents.reports_from(spark, list(reports))


def listed(store):
    return sorted((r["scan_id"], r["generated_at"], r["imported"]) for r in store.index().collect())


def test_the_last_put_of_a_scan_counts(spark, tmp_path):
    store = ReportTable(spark, str(tmp_path))
    assert store.index().count() == 0 and store.current().count() == 0
    store.put(made(spark, report("a", generated_at="2026-01-01T00:00:00Z"), report("b", generated_at="2026-01-02T00:00:00Z", warnings=["w"])))
    store.put(made(spark, report("a", generated_at="2026-01-03T00:00:00Z", warnings=["x", "y"])), imported=True, source="/f")
    assert listed(store) == [("a", "2026-01-03T00:00:00Z", True), ("b", "2026-01-02T00:00:00Z", False)]
    assert {r["scan_id"]: (r["warnings_count"], r["source_path"], r["backend"]) for r in store.index().collect()} == {"a": (2, "/f", "native"), "b": (1, None, "native")}
    assert store.get("a").first()["warnings"] == ["x", "y"] and store.get("none").count() == 0
    store.remove(store.current().where("scan_id = 'b'"))
    assert [x[0] for x in listed(store)] == ["a"]
    store.put(made(spark, report("b")))
    assert [x[0] for x in listed(store)] == ["a", "b"]


def test_two_writers_lose_nothing(spark, tmp_path):
    def write(who):
        for k in range(3):
            ReportTable(spark, str(tmp_path)).put(made(spark, report(f"{who}{k}"), report("both")))

    writers = [threading.Thread(target=write, args=(w,)) for w in "xyz"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    store = ReportTable(spark, str(tmp_path))
    assert [x[0] for x in listed(store)] == sorted(["both", *(f"{w}{k}" for w in "xyz" for k in range(3))]) and len(store.log.names()) == 9


def test_a_put_that_was_lost_is_not_seen(spark, tmp_path):
    store = ReportTable(spark, str(tmp_path))
    store.put(made(spark, report("a")))
    rows = store.log.read().withColumns({"scan_id": F.lit("lost"), "put": F.lit("99")})
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.log.folder}/99")
    assert [x[0] for x in listed(store)] == ["a"]


def test_compaction_keeps_what_is_put_meanwhile(spark, tmp_path):
    store = ReportTable(spark, str(tmp_path))
    for k in range(3):
        store.put(made(spark, report("a", generated_at=f"2026-01-0{k + 1}T00:00:00Z"), report(f"s{k}")))
    before = listed(store)
    store.compact()
    assert listed(store) == before and len(store.log.names()) == 1
    store.put(made(spark, report("a", generated_at="2026-02-01T00:00:00Z")))
    store.compact()
    assert ("a", "2026-02-01T00:00:00Z", False) in listed(store) and len(listed(store)) == 4


def test_a_compaction_that_was_lost_changes_nothing(spark, tmp_path, monkeypatch):
    store = ReportTable(spark, str(tmp_path))
    for k in range(3):
        store.put(made(spark, report("a", generated_at=f"2026-01-0{k + 1}T00:00:00Z"), report(f"s{k}")))
    store.remove(store.current().where("scan_id = 's0'"))
    before, names = listed(store), store.log.names()
    drop = store.log.drop
    for lost in (0, 2):  # before any commit went, and after some
        monkeypatch.setattr(store.log, "drop", lambda n, lost=lost: drop(n[:lost]))
        store.compact()
        assert listed(store) == before and len(store.log.names()) >= len(names) - lost
    monkeypatch.setattr(store.log, "drop", drop)
    store.compact()
    assert listed(store) == before and len(store.log.names()) == 1 and {x[0] for x in before} == {"a", "s1", "s2"}


def test_history_and_orphans(spark, tmp_path):
    store = ReportTable(spark, str(tmp_path))
    for k in (2, 0, 1):
        store.put(made(spark, report(f"r{k}", [disk("D", "/d", 100, 90 - k)], generated_at=f"2026-01-0{k + 1}T00:00:00Z")))
    d, p = store.snapshots()
    assert sorted((r["snap_pos"], r["scan_id"], r["free_space_bytes"]) for r in d.collect()) == [(0, "r0", 90), (1, "r1", 89), (2, "r2", 88)] and p.count() == 0
    paths = [(r["stored_report_path"],) for r in store.index().collect()]
    gone = spark.createDataFrame([*paths, ("/elsewhere",)], "path string")
    assert [r["path"] for r in store.orphans(gone).collect()] == ["/elsewhere"]


def test_long_lists_are_stored_in_pieces_and_counted_without_being_read(spark, tmp_path):
    store, n = ReportTable(spark, str(tmp_path)), 5 * ReportTable.PIECE + 3
    texts = [f"w{k}" for k in range(n)]
    store.put(made(spark, report("long", [disk(f"D{k}", f"/d{k}", 100, k) for k in range(ReportTable.PIECE + 1)], warnings=texts), report("short", warnings=["x"])))
    assert store.log.read().selectExpr("max(size(warnings))").first()[0] == ReportTable.PIECE
    assert {r["scan_id"]: r["warnings_count"] for r in store.index().collect()} == {"long": n, "short": 1}
    plan = store.index()._jdf.queryExecution().executedPlan().toString()
    assert "warnings_count" in plan and "warnings:array" not in plan and "recommendations:array" not in plan
    got = store.get("long").first()
    assert got["warnings"] == texts and len(got["disks"]) == ReportTable.PIECE + 1 and got["policy_decisions"] is not None and got["paths"] == []
    assert sorted(r["free_space_bytes"] for r in store.snapshots()[0].collect()) == list(range(ReportTable.PIECE + 1))
    store.remove(store.current().where("scan_id = 'short'"))
    store.compact()
    assert store.get("long").first()["warnings"] == texts and [x[0] for x in listed(store)] == ["long"]


def test_a_report_that_comes_in_parts_is_one(spark, tmp_path):
    store = ReportTable(spark, str(tmp_path))
    parts = spark.createDataFrame([("s", 1, "t", ["c"]), ("s", 0, "t", [str(k) for k in range(70)]), ("s", 2, "t", ["d"])], "scan_id string, part bigint, generated_at string, warnings array<string>")
    store.put(parts)
    assert [(r["scan_id"], r["generated_at"], r["warnings_count"], r["recommendation_count"]) for r in store.index().collect()] == [("s", "t", 72, 0)]
    assert store.get("s").first()["warnings"] == [*(str(k) for k in range(70)), "c", "d"]
    store.put(made(spark, report("s", warnings=["only"]), report("s", warnings=["only"])))  # two of a scan in one put: one of them counts
    assert [r["warnings_count"] for r in store.index().collect()] == [1] and store.get("s").first()["warnings"] == ["only"]
