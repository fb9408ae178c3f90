"""Whole reports: the rules on five shapes, the store, the cache, a real file tree, the commands."""

import json
import os
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stowage import cli, markdown, schemas, service, workbench
from stowage.plans import evaluate
from stowage.sinks import History, ReportStore, ScanCache, file_stem
from stowage.sources import devices, documents, filetree

GIB = 1 << 30


def disk(name, mount, total, free, **kw):
    base = {"name": name, "mount_point": mount, "total_space_bytes": total, "free_space_bytes": free, "disk_kind": "ssd", "storage_type": "ssd", "locality_class": "local_physical",
            "is_os_drive": False, "is_removable": False, "performance_class": "fast", "performance_confidence": 0.8, "eligible_for_local_target": True}
    return base | kw


def report(scan_id=None, disks=(), paths=(), categories=(), duplicates=(), warnings=(), **kw):
    out = {"report_version": "1.2.0", "generated_at": "2026-02-11T00:00:00Z", "scan": {"roots": [], "excludes": [], "dedupe": True, "dedupe_min_size": 1, "dry_run": False},
           "disks": list(disks), "paths": list(paths), "categories": list(categories), "duplicates": list(duplicates), "recommendations": [], "warnings": list(warnings)}
    return out | ({"scan_id": scan_id} if scan_id else {}) | kw


def category(mount, name, confidence):
    return {"target": mount, "disk_mount": mount, "category": name, "confidence": confidence, "rationale": "", "evidence": []}


CLOUD = {"locality_class": "cloud_backed", "storage_type": "cloud_backed", "performance_class": "slow", "eligible_for_local_target": False, "ineligible_reasons": ["cloud"]}
OS = {"is_os_drive": True, "eligible_for_local_target": False, "ineligible_reasons": ["os"]}
SHAPES = {
    "sample": report("sample", [disk("System", "C:\\", 500 * GIB, 200 * GIB, **OS), disk("Data", "D:\\", 1000 * GIB, 600 * GIB, storage_type="hdd", performance_class="slow"), disk("Cloud", "J:\\", 100 * GIB, 50 * GIB, **CLOUD)],
                     categories=[category("D:\\", "work", 0.8), category("C:\\", "work", 0.3)],
                     duplicates=[{"size_bytes": 157286400, "hash": "h", "files": [{"path": f"D:\\{i}", "disk_mount": "D:\\"} for i in range(3)], "total_wasted_bytes": 314572800, "intent": {"label": "likely_redundant", "rationale": ""}}],
                     warnings=["Permission denied: x"]),
    "active": report("active", [disk("System", "C:\\", 500 * GIB, 200 * GIB, **OS), disk("Slow", "D:\\", 100 * GIB, 60 * GIB, storage_type="hdd", performance_class="slow", performance_confidence=0.75),
                                disk("Fast", "E:\\", 100 * GIB, 66 * GIB, storage_type="nvme", performance_confidence=0.9)], categories=[category("D:\\", "games", 0.9), category("D:\\", "work", 0.5)]),
    "headroom": report("headroom", [disk("System", "C:\\", 100 * GIB, 8 * GIB, **OS), disk("Media", "D:\\", 100 * GIB, 60 * GIB), disk("Cloud", "J:\\", 100 * GIB, 50 * GIB, **CLOUD)], categories=[category("D:\\", "media", 0.9)]),
    "games": report("games", [disk("Slow", "D:\\", 100 * GIB, 60 * GIB, storage_type="hdd", performance_class="slow"), disk("Fast", "E:\\", 100 * GIB, 66 * GIB)], categories=[category("D:\\", "games", 0.95)]),
    "risky": report("risky", [disk("Photos", "F:\\", 1000, 25)], categories=[category("F:\\", "media", 0.95)]),
}
EXPECTED = {"sample": ["backup-gap", "duplicate-cleanup-candidate", "cloud-backed-target-exclusion"], "active": ["active-workload-placement", "backup-gap"],
            "headroom": ["os-headroom", "cloud-backed-target-exclusion"], "games": ["active-workload-placement"], "risky": ["risky-disk-F--"]}


@pytest.fixture(scope="module")
def bundle(spark):
    out = service.recommend(documents.reports_from(spark, list(SHAPES.values())))
    return {k: v.cache() for k, v in out.items()}


def test_rules_on_five_shapes(bundle):
    got = {}
    for r in bundle["recommendations"].orderBy("scan_id", "pos").collect():
        got.setdefault(r["scan_id"], []).append(r["id"])
    assert got == EXPECTED


def test_numbers_of_the_rules(bundle):
    r = {(x["scan_id"], x["id"]): x for x in bundle["recommendations"].collect()}
    assert r["sample", "duplicate-cleanup-candidate"]["space_saving_bytes"] == 314572800
    assert r["active", "active-workload-placement"]["confidence"] == pytest.approx(0.92) and r["active", "active-workload-placement"]["target_mount"] == "E:\\"
    assert r["headroom", "os-headroom"]["confidence"] == pytest.approx(0.72) and r["risky", "risky-disk-F--"]["risk_level"] == "high"
    assert bundle["rule_traces"].where("scan_id = 'sample'").count() == 10
    assert bundle["policy_decisions"].where("scan_id = 'sample' and action = 'allowed'").count() == 3
    kinds = [e["kind"] for e in r["sample", "duplicate-cleanup-candidate"]["evidence"]]
    assert kinds == ["duplicate_group", "warning"] and [e["kind"] for e in r["risky", "risky-disk-F--"]["evidence"]] == ["other"]
    assert bundle["rule_traces"].where("scan_id = 'risky' and rule_id = 'risky_disk'").first()["recommendation_id"] is None


def test_scenarios_of_the_sample(spark):
    p = service.plan(documents.reports_from(spark, [SHAPES["sample"]])).collect()
    assert [(x["projected_space_saving_bytes"], x["recommendation_count"], x["blocked_recommendation_count"]) for x in p] == [(0, 1, 0), (314572800, 2, 0), (314572800, 3, 0)]


def test_evaluation_of_the_shapes(spark):
    cases = spark.createDataFrame([(k, k, EXPECTED[k], ["consolidation-opportunity"]) for k in SHAPES], "name string, scan_id string, expected_top_ids array<string>, forbidden_ids array<string>")
    res, total = service.evaluate_cases(cases, documents.reports_from(spark, list(SHAPES.values())))
    t = evaluate.quality_gate(total).first()
    assert (t["total_cases"], t["passed_cases"], t["precision_at_3"], t["unsafe_recommendations"], t["passed_gate"]) == (5, 5, 1.0, 0, True)


def test_consolidation_needs_coverage_and_room(spark):
    paths = [{"root_path": m, "disk_mount": m, "total_size_bytes": 50 * GIB, "file_count": 1, "directory_count": 0, "largest_files": {"entries": []}, "largest_directories": [],
              "file_type_summary": {"top_extensions": [], "other_files": 0, "other_bytes": 0, "total_files": 0, "total_bytes": 0}, "activity": {"recent_files": 0, "stale_files": 0, "unknown_modified_files": 0}} for m in ("/a", "/b")]
    two = [disk("A", "/a", 100 * GIB, 40 * GIB), disk("B", "/b", 300 * GIB, 200 * GIB)]
    ids = lambda r: [x["id"] for x in service.recommend(documents.reports_from(spark, [r]))["recommendations"].collect()]
    assert "consolidation-opportunity" in ids(report("c", two, paths))
    assert "consolidation-opportunity" not in ids(report("c", two, paths[:1]))


def test_growth_is_blocked_for_the_system_disk(spark):
    h = {"snapshots": [{"scan_id": str(i), "generated_at": f"2026-01-0{i + 1}T00:00:00Z", "disks": [{"mount_point": m, "total_space_bytes": 100 * GIB, "free_space_bytes": (90 - 40 * i) * GIB} for m in ("C:\\", "D:\\")], "paths": []} for i in range(2)]}
    history = spark.createDataFrame([(json.dumps(h),)], "v string").select(F.from_json("v", schemas.HISTORY_SCHEMA).alias("h")).select("h.*")
    b = service.recommend(documents.reports_from(spark, [SHAPES["active"]]), history)
    ids = [r["id"] for r in b["recommendations"].orderBy("pos").collect()]
    assert "disk-growth-D" in ids and "disk-growth-C" not in ids


def test_defaults_and_required_fields(spark):
    d = report()
    del d["warnings"]
    with pytest.raises(Exception, match="missing field: warnings"):
        documents.reports_from(spark, [d]).collect()
    r = documents.reports_from(spark, [report(disks=[{"name": "x", "mount_point": "/", "total_space_bytes": 1, "free_space_bytes": 1, "disk_kind": "ssd"}])]).first()
    assert r["scan_id"] == "unknown" and r["scan"]["progress_interval_ms"] == 250 and r["disks"][0]["role_hint"]["role"] == "unknown" and r["scan_metrics"]["backend"] == "native"


def test_store(spark, tmp_path):
    st = ReportStore(str(tmp_path))
    st.put(report("a", generated_at="2026-01-01T00:00:00Z"))
    st.put(report("../../evil", generated_at="2026-01-03T00:00:00Z"))
    st.put(report("a", generated_at="2026-01-02T00:00:00Z"))
    assert [e["scan_id"] for e in st.list()] == ["../../evil", "a"] and st.get("a")["generated_at"] == "2026-01-02T00:00:00Z"
    assert os.path.realpath(st.path("../../evil")).startswith(os.path.realpath(str(tmp_path))) and st.get("../../evil")["scan_id"] == "../../evil"
    os.remove(st.path("a"))
    assert [e["scan_id"] for e in st.list()] == ["../../evil"]
    with pytest.raises(KeyError):
        st.get("../index")
    with pytest.raises(KeyError):
        st.get("a")
    f = tmp_path / "in.json"
    f.write_text(json.dumps(report("imp")))
    e = st.import_file(str(f))
    assert e["imported"] and st.get("imp") == report("imp") and st.table(spark).count() == 2
    assert file_stem("scan-1") != "scan-1" and file_stem("a b") != "a b" and file_stem("ok_1") == "ok_1"


def test_cache(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    now = datetime.now(UTC)
    c, key = ScanCache(str(tmp_path / "c"), 60), {"roots": [str(root)]}
    assert c.get(key, [str(root)])[1] == "not_found"
    c.put(key, [str(root)], {"warnings": []}, now)
    assert c.get(key, [str(root)], now + timedelta(seconds=60))[1] == "hit" and c.get(key, [str(root)], now + timedelta(seconds=61))[1] == "expired"
    os.utime(root, (1, 1))
    assert c.get(key, [str(root)], now)[1] == "changed"
    assert ScanCache(str(tmp_path), enabled=False).get(key, [])[1] == "disabled"
    c.put(key | {"x": 1}, [], {"warnings": ["scan canceled"]})
    assert c.get(key | {"x": 1}, [])[1] == "not_found"
    open(c.path(key), "w").write("{")
    assert c.get(key, [str(root)])[1] == "bad_json"


@pytest.fixture
def tree(tmp_path):
    r = tmp_path / "tree"
    for p, text in ((".dot", "d"), ("_x", "u"), ("empty", ""), ("a/one.txt", "same"), ("a/b/two.txt", "same"), ("a/b/skip.tmp", "t"), ("cache/in/x", "c")):
        (r / p).parent.mkdir(parents=True, exist_ok=True)
        (r / p).write_text(text)
    (r / "void").mkdir()
    os.symlink(r / "a", r / "link")
    return str(r)


def test_file_tree_source(spark, tree):
    t = filetree.read_tree(spark, [tree], excludes=["*.tmp", "cache"], with_hash=True).collect()
    files = sorted(os.path.relpath(r["path"], tree) for r in t if r["kind"] == "file")
    assert files == [".dot", "_x", "a/b/two.txt", "a/one.txt", "empty"]
    assert sorted(os.path.relpath(r["path"], tree) for r in t if r["kind"] == "directory") == ["a", "a/b", "void"]
    flat = filetree.read_tree(spark, [tree], max_depth=1).where("kind = 'file'").count()
    assert flat == 3
    assert filetree.read_tree(spark, [tree + "/none"]).where("kind = 'warning'").count() == 1


def test_scan_end_to_end(spark, tree, tmp_path):
    store, seen = str(tmp_path / "store"), []
    probes = spark.createDataFrame([("s", 0, "disk", "/", 100 * GIB, 50 * GIB, "ssd", "ext4", False)], "scan_id string, pos int, name string, mount_point string, total_space_bytes bigint, free_space_bytes bigint, disk_kind string, file_system string, is_removable boolean").withColumn("scan_id", F.lit("one"))
    hints = spark.createDataFrame([], devices.HINT)
    opts = service.ScanOptions(roots=[tree, tree.upper(), tree + "/none"], excludes=["*.tmp"], dedupe_min_size=0)
    r = service.scan(spark, opts, store, seen.append, probes, hints, "one")
    assert r["scan_metrics"]["scanned_files"] == 6 and r["paths"][0]["directory_count"] == 5 and r["paths"][0]["disk_mount"] == "/"
    assert [d["size_bytes"] for d in r["duplicates"]] == [4] and any("does not exist" in w for w in r["warnings"])
    assert seen[-1]["phase"] == "done" and len(seen) == r["scan_progress_summary"]["total_events"] == 7 + 1
    svc = service.Service(spark, store)
    assert [e["scan_id"] for e in svc.list_reports()] == ["one"] and len(json.load(open(History(store).path))["snapshots"]) == 1
    d = svc.compare_reports("one", "one")
    assert all(d[k].count() == 0 for k in ("disk_diffs", "path_diffs", "recommendation_changes"))
    assert "## Disks" in open(svc.export_markdown_summary(r, str(tmp_path / "m.md"))).read()
    back = svc.plan_scenarios_from_report(svc.get_report("one"))
    assert back.count() == 3


def test_parity_of_two_plans(spark, tree):
    p = service.parity(spark, service.ScanOptions(roots=[tree])).first()
    assert (p["scanned_files_delta"], p["scanned_bytes_delta"], p["within_tolerance"]) == (0, 0, True)


def test_sessions(spark):
    from stowage.streaming.sessions import Sessions

    s = Sessions(spark)

    def good(scan_id, emit, cancelled):
        emit({"phase": "done"})
        return {"scan_id": scan_id}

    def bad(scan_id, emit, cancelled):
        raise ValueError("no")

    def slow(scan_id, emit, cancelled):
        while True:
            emit({"phase": "walking_files"})
            time.sleep(0.01)

    a, b, c = s.start(good), s.start(bad), s.start(slow)
    assert s.wait(a)["status"] == "completed" and s.events(a)[0]["seq"] == 1 and s.events(a, 1) == []
    assert s.wait(b)["status"] == "failed" and s.get(b)["error"] == "no"
    assert s.cancel(c) and s.wait(c)["status"] == "cancelled" and not s.cancel(c)
    with pytest.raises(KeyError):
        s.get("none")


def test_markdown_shows_twenty_duplicates(spark):
    dups = [{"size_bytes": 1, "hash": f"h{i:02}", "files": [], "total_wasted_bytes": 1, "intent": {"label": "likely_redundant", "rationale": ""}} for i in range(25)]
    text = markdown.render(schemas.tables(documents.reports_from(spark, [report("m", duplicates=dups)])), "m", "now")
    assert text.count("wasted") == 20 and "None." in text


def test_lsblk_and_cim(spark):
    tree_ = {"blockdevices": [{"model": "M ", "tran": "nvme", "rota": False, "mountpoint": "", "children": [
        {"mountpoint": "/", "mountpoints": ["/", "/home", None], "vendor": "V", "children": [{"mountpoint": "/deep", "rota": "1", "children": [{"children": [{"mountpoint": "/deeper"}]}]}]}, {"mountpoint": "/b"}]}]}
    docs = spark.createDataFrame([("one", json.dumps(tree_)), ("bad", "{"), ("none", None), ("other", '{"blockdevices": {"mountpoint": "/x"}}'), ("empty", '{"blockdevices": []}')], "doc string, text string")
    got = [tuple(r) for r in devices.lsblk_rows(docs).orderBy("doc", "pos").collect()]
    assert [(r[0], r[2], r[3], r[4], r[5], r[6], round(r[7], 2)) for r in got] == [
        ("one", "/", "V", "M", "nvme", False, 0.9), ("one", "/home", "V", "M", "nvme", False, 0.9), ("one", "/deep", "V", "M", "nvme", True, 0.9), ("one", "/deeper", "V", "M", "nvme", True, 0.9),
        ("one", "/b", None, "M", "nvme", False, 0.85)] and [r[1] for r in got] == [0, 1, 2, 3, 4]
    cim = [("a", '{"DriveLetter": "c", "MediaType": "SSD", "Model": "X"}'), ("b", '[{"mount_point": "d:\\\\", "vendor": " V ", "interface": "USB", "media_type": "Fixed hard disk"}, {"Model": "no drive"}]'), ("c", "7"), ("d", "")]
    got = {r["mount_point"]: tuple(r)[3:] for r in devices.cim_rows(spark.createDataFrame(cim, "doc string, text string")).collect()}
    assert got == {"C:\\": (None, "X", None, False, 0.84, "cim"), "D:\\": ("V", None, "USB", True, 0.84, "cim")}


def test_lsblk_trees_are_flattened_in_one_pass_at_any_depth(spark):
    node = {"mountpoint": "/150"}
    for k in reversed(range(150)):
        node = {"mountpoint": f"/{k}", "vendor": f"V{k}" if k % 50 == 0 else " ", "children": [7, node, {"mountpoint": f"/after{k}"}]}
    wide = {"blockdevices": [{"mountpoints": [f"/[{k}", None, "/s"], "children": [{"model": str(k)}, {"mountpoint": "/c"}]} for k in range(2000)]}
    rows = devices.lsblk_rows(spark.createDataFrame([("deep", json.dumps({"blockdevices": [node]})), ("wide", json.dumps(wide))], "doc string, text string"))
    got = [tuple(r) for r in rows.orderBy("doc", "pos").select("doc", "mount_point", "vendor").collect()]
    assert [g[1:] for g in got if g[0] == "deep"] == [(f"/{k}", f"V{min(k, 149) // 50 * 50}") for k in range(151)] + [(f"/after{k}", f"V{k // 50 * 50}") for k in reversed(range(150))]
    assert [g[1] for g in got if g[0] == "wide"] == [m for k in range(2000) for m in (f"/[{k}", "/s", "/c")]
    plan = rows.drop("pos")._jdf.queryExecution().optimizedPlan().toString()
    assert "UnionLoop" not in plan and "Window" not in plan and "Join" not in plan


def test_hints_of_a_platform(spark):
    from types import SimpleNamespace

    said = lambda text, code=0: lambda *a, **kw: SimpleNamespace(returncode=code, stdout=text)
    lsblk = devices.platform_hints(spark, said('{"blockdevices": [{"mountpoint": "/", "model": "M"}]}'), "Linux").collect()
    assert [(r["pos"], r["mount_point"], r["model"], r["source"]) for r in lsblk] == [(0, "/", "M", "lsblk")]
    assert devices.platform_hints(spark, said('{"mount_point": "e:", "media_type": "ssd"}'), "Windows").first()["mount_point"] == "E:\\"
    assert devices.platform_hints(spark, said("", 1), "Linux").count() == 0 and devices.platform_hints(spark, said("{}"), "Plan9").count() == 0


def test_commands(spark, tmp_path, capsys):
    f = tmp_path / "r.json"
    f.write_text(json.dumps(SHAPES["risky"]))
    assert cli.main(["plan", str(f)], spark) == 0 and json.loads(capsys.readouterr().out)[2]["recommendation_ids"] == ["risky-disk-F--"]
    assert cli.main(["reports", "import", str(f), "--store", str(tmp_path / "s")], spark) == 0
    capsys.readouterr()
    assert cli.main(["reports", "list", "--store", str(tmp_path / "s")], spark) == 0 and json.loads(capsys.readouterr().out)[0]["scan_id"] == "risky"
    suite = tmp_path / "suite.json"
    suite.write_text(json.dumps({"cases": [{"name": "r", "report": "r.json", "expected_top_ids": ["risky-disk-F--"], "forbidden_ids": []}]}))
    assert cli.main(["eval", str(suite)], spark) == 0 and json.loads(capsys.readouterr().out)["summary"][0]["passed_gate"]
    assert workbench.markdown_path("/x/r.JSON") == "/x/r.md" and workbench.diagnostics_path() == "report.diagnostics.json" and workbench.diff_path(" a ", "") == "a-to-right.diff.json"


def test_only_sizes_that_occur_twice_are_hashed(spark, tree, monkeypatch):
    files = filetree.files_of(filetree.read_tree(spark, [tree]), "s")
    assert files.where("content_hash is not null").count() == 0
    from stowage.operators import duplicates

    want = duplicates.candidates(files, 1)
    got = filetree.hashed(want).collect()
    assert sorted(os.path.relpath(r["path"], tree) for r in got) == sorted(os.path.relpath(r["path"], tree) for r in want.collect())
    assert len(got) == 6 and len({r["content_hash"] for r in got}) == 5  # four files of one byte and two of four; the empty one is alone


def test_a_file_that_cannot_be_read_stays_in_the_inventory(spark, tmp_path, monkeypatch):
    root = tmp_path / "r"
    root.mkdir()
    for n in ("a", "b", "c"):
        (root / n).write_text("same")
    gone = spark.createDataFrame([(str(root / "a"), 4), (str(root / "none"), 4)], "path string, size_bytes bigint")
    got = {os.path.basename(r["path"]): (r["content_hash"] is None, r["warning"] is None) for r in filetree.hashed(gone).collect()}
    assert got == {"a": (False, True), "none": (True, False)}
    reader = filetree.FileTreeReader({"roots": json.dumps([str(root)]), "hash": "true"})
    monkeypatch.setattr(filetree, "digest", lambda p: (_ for _ in ()).throw(PermissionError("Permission denied")) if p.endswith("b") else "h")
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted((os.path.basename(r[1]), r[2], r[5]) for r in rows) == [("a", "file", "h"), ("b", "file", None), ("b", "warning", None), ("c", "file", "h")]


def test_one_big_directory_is_split(spark, tmp_path):
    for i in range(12):
        (tmp_path / "big" / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / "big" / f"d{i}" / "e" / "f").write_text("x" * i)
    parts = filetree.FileTreeReader({"roots": json.dumps([str(tmp_path)])}).partitions()
    assert len(parts) >= 1 and sum(p.deep for p in parts) in (0, 12)
    t = filetree.read_tree(spark, [str(tmp_path)])
    assert t.where("kind = 'file'").count() == 12 and t.where("kind = 'directory'").count() == 25
    assert filetree.read_tree(spark, [str(tmp_path)], max_depth=2).where("kind = 'directory'").count() == 13


def test_two_backends_agree(spark, tree):
    probes = spark.createDataFrame([("s", 0, "disk", "/", 100 * GIB, 50 * GIB, "ssd", "ext4", False)], devices.PROBE.replace("pos int", "scan_id string, pos int"))
    one, two = (service.scan(spark, service.ScanOptions(roots=[tree], dedupe=False, backend=b), probes=probes, hints=spark.createDataFrame([], devices.HINT)) for b in ("native", "pdu"))
    assert one["paths"] == two["paths"] and one["paths"][0]["largest_directories"] and (one["scan"]["backend"], two["scan_metrics"]["backend"]) == ("native", "pdu")


def test_roots_of_a_scan_that_names_none(spark, tree):
    mounts = [("s", i, "d", m, 100 * GIB, 50 * GIB, "ssd", "ext4", False) for i, m in enumerate(("/proc", "/dev/shm", tree, tree.upper(), "/run/x"))]
    probes = spark.createDataFrame(mounts, devices.PROBE.replace("pos int", "scan_id string, pos int"))
    assert service.auto_roots(spark, probes) == [tree]
    r = service.scan(spark, service.ScanOptions(dedupe=False), probes=probes, hints=spark.createDataFrame([], devices.HINT))
    assert [p["root_path"] for p in r["paths"]] == [tree]


def test_a_cancelled_scan_keeps_what_it_has(spark, tree, tmp_path):
    from stowage.streaming.sessions import Cancelled

    stop, probes = [], spark.createDataFrame([("s", 0, "disk", "/", 100 * GIB, 50 * GIB, "ssd", "ext4", False)], devices.PROBE.replace("pos int", "scan_id string, pos int"))

    def on_event(e):
        if e["current_path"]:
            stop.append(e)
            raise Cancelled

    r = service.scan(spark, service.ScanOptions(roots=[tree], dedupe=False, cache=True), str(tmp_path / "s"), on_event, probes, spark.createDataFrame([], devices.HINT), cancelled=lambda: bool(stop))
    assert r["paths"][0]["file_count"] == 7 and r["recommendations"] == [] and not r["scan_progress_summary"]["completed"]
    assert any("scan canceled" in w for w in r["warnings"]) and not os.path.exists(tmp_path / "s" / "history.json") and documents.reports_from(spark, [r]).count() == 1


def test_hints_of_one_mount_make_one_disk(spark):
    from stowage.operators import disks

    probes = spark.createDataFrame([("s", 0, "raid", "/r", 10, 5, "unknown", "ext4", False), ("s", 1, "win", "d:", 10, 5, "unknown", "ntfs", False)], devices.PROBE.replace("pos int", "scan_id string, pos int"))
    hints = spark.createDataFrame([(0, "/r", "A", None, None, True, 0.7, "x"), (1, "/r/", "B", "M", None, None, 0.9, "y"), (2, "D:/", "W", None, "USB", None, 0.8, "cim")], devices.HINT)
    got = {r["mount_point"]: (r["vendor"], r["model"], r["storage_type"], r["interface"]) for r in disks.enrich(probes, hints, "D:\\").collect()}
    assert got == {"/r": ("B", "M", "hdd", None), "d:": ("W", "win", "usb", "usb")}


def test_workbench(spark, bundle):
    assert workbench.appended(["a"], " b ") == ["a", "b"] and workbench.appended(["a"], "a ") == ["a"] and workbench.appended([], " ") == []
    assert workbench.default_store({"HOME": "/h"}, "posix") == "/h/.local/state/stowage/reports" and workbench.store_folder("/x") == "/x"
    disks_ = service.with_scans(documents.reports_from(spark, list(SHAPES.values())))["disks"]
    got = workbench.of_recommendation({k: v.where("scan_id = 'active'") for k, v in bundle.items()}, disks_, "active-workload-placement")
    assert {k: v.count() for k, v in got.items()} == {"recommendation": 1, "policy_decisions": 2, "rule_traces": 1, "disk": 1} and got["disk"].first()["mount_point"] == "E:\\"
