"""Operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stowage.functions import scalars as s
from stowage.operators import classify, disks, duplicates, filters, mounts, usage
from stowage.plans import diff, evaluate, policy, scenario, trend
from stowage.streaming import events as ev

NOW = dt.datetime(2026, 2, 11)
FILE = "scan_id string, root_path string, path string, size_bytes bigint, disk_mount string, modified_ts timestamp, extension string, top_dir string, content_hash string"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.fixture
def files(spark):
    data = [("/r/a/x.txt", 10, "h1", 1), ("/r/a/y.TXT", 10, "h1", 800), ("/r/b/z.md", 30, "h2", 400), ("/r/b/.hid", 10, "h3", None), ("/r/top.md", 5, "h4", 730), ("/q/x.txt", 7, "h5", 90)]
    out = []
    for p, n, h, age in data:
        root = p[:2]
        out.append(("s", root, p, n, "/m", None if age is None else NOW - dt.timedelta(days=age), None, None, h))
    df = spark.createDataFrame(out, FILE)
    return df.withColumns({"extension": s.extension(F.col("path")), "top_dir": s.top_directory(F.col("path"), F.col("root_path"))})


def test_extension_and_top_directory(spark):
    df = spark.createDataFrame([("/r/a.tar.GZ",), ("/r/.bashrc",), ("/r/noext",), ("/r/a.",), ("/r/d.x/file",)], "p string")
    assert [r[0] for r in df.select(s.extension(F.col("p"))).collect()] == ["gz", "none", "none", "", "none"]
    assert [r[0] for r in df.select(s.top_directory(F.col("p"), F.lit("/r"))).collect()] == [None, None, None, None, "/r/d.x"]
    assert [r[0] for r in df.select(s.top_directory(F.col("p"), F.lit("/"))).collect()] == ["/r"] * 5


def test_totals_and_activity(files):
    got = {r["root_path"]: r for r in usage.totals(files, F.lit(NOW)).collect()}
    r = got["/r"]
    assert (r["file_count"], r["total_size_bytes"], r["recent_files"], r["stale_files"], r["unknown_modified_files"]) == (5, 65, 1, 2, 1)
    assert got["/q"]["recent_files"] == 1  # 90 days is recent


def test_top_plus_other_is_the_total(files):
    for k in (0, 1, 2, 12):
        for r in usage.extension_summary(files, k).collect():
            assert sum(e["bytes"] for e in r["top_extensions"]) + r["other_bytes"] == r["total_bytes"]
            assert len(r["top_extensions"]) <= k
    assert rows(usage.top(usage.extensions(files), 0, "extension"), "extension") == []


def test_tree_rollup_agrees_with_totals(files):
    rolled = {(r["root_path"], r["path"]): r["size_bytes"] for r in usage.tree_rollup(files).collect()}
    assert rolled[("/r", "/r")] == 65 and rolled[("/r", "/r/a")] == 20


def test_duplicates(files, spark):
    g = duplicates.duplicate_groups(files).collect()
    assert len(g) == 1 and g[0]["total_wasted_bytes"] == 10 and [f["path"] for f in g[0]["files"]] == ["/r/a/x.txt", "/r/a/y.TXT"] and g[0]["intent"] == "likely_redundant"
    twice = duplicates.duplicate_groups(files.unionByName(files))
    assert rows(twice, "hash", "file_count") == [("h1", 2)]  # overlapping roots are no copies
    assert sorted(rows(duplicates.duplicate_groups(files.orderBy(F.rand(3))), "hash", "file_count")) == [("h1", 2)]
    kept = files.withColumn("path", F.replace("path", F.lit("/a/"), F.lit("/Backup/")))
    assert rows(duplicates.duplicate_groups(kept), "intent") == [("likely_intentional",)]
    assert duplicates.duplicate_groups(files.limit(0)).count() == 0


def test_mirror_copies_on_two_mounts_are_intentional(spark):
    df = spark.createDataFrame([("s", "/r", f"/{m}/Lib/a.txt", 9, f"/{m}", None, "txt", None, "h") for m in ("d1", "d2")], FILE)
    assert rows(duplicates.duplicate_groups(df), "intent", "mounts") == [("likely_intentional", 2)]


def test_mount_match_goes_by_component(spark):
    p = spark.createDataFrame([("/src10/x",), ("/src1/x",), ("/elsewhere",), ("C:\\data\\x",), (None,)], "root_path string")
    m = spark.createDataFrame([(0, "/"), (1, "/src1"), (2, "C:\\data"), (3, "/src1/")], "pos int, mount_point string")
    got = dict(rows(mounts.match_mounts(p, m), "root_path", "disk_mount"))
    assert got == {"/src10/x": "/", "/src1/x": "/src1/", "/elsewhere": "/", "C:\\data\\x": "C:\\data", None: None}


def test_roots_differing_in_case_only(spark):
    r = spark.createDataFrame([(0, "/A"), (1, "/a"), (2, "/b")], "pos int, path string")
    assert sorted(rows(mounts.resolve_roots(r), "path")) == [("/A",), ("/b",)]
    m = spark.createDataFrame([(0, "/"), (1, "/proc/sys"), (2, "/mnt"), (3, "/mnt2")], "pos int, mount_point string")
    assert sorted(rows(mounts.resolve_roots(r.limit(0), m), "path")) == [("/",), ("/mnt2",)]


def test_excludes(spark):
    x = filters.Excludes([" node_modules ", "*.tmp", "/a/{b,c}/[!x]*", "[", ""])
    assert len(x.warnings) == 1 and x.words == ["node_modules", "["]
    df = spark.createDataFrame([(p, "/a") for p in ("/a/Node_Modules/z/f", "/a/k.tmp", "/a/b/x", "/a/c/y", "/a/d/f.txt", "/a/x.tmp/deep/f")], "path string, root_path string")
    assert [r[0] for r in x.prune(df).select("path").collect()] == ["/a/b/x", "/a/d/f.txt"]
    assert x.matches("/a/k.tmp") and not x.matches("/a/b/x")


@pytest.mark.parametrize("kw", [{"min_ratio": 1.1}, {"min_ratio": -0.1}, {"progress_interval_ms": 0}, {"cache": True, "ttl_seconds": 0}])
def test_options_are_checked(kw):
    with pytest.raises(ValueError):
        filters.validate_options(**kw)


def probe(spark, *rows_):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows_)], "scan_id string, pos int, name string, mount_point string, total_space_bytes bigint, free_space_bytes bigint, disk_kind string, file_system string, is_removable boolean")


def test_disk_enrichment(spark):
    d = disks.enrich(probe(spark, ("Google Drive x@gmail.com", "/g", 10, 5, "unknown", "fuse", False), ("Samsung NVMe", "/n", 10, 5, "ssd", "ext4", False), ("sys", "/", 10, 5, "ssd", "ext4", False),
                           ("nas", "/nas", 10, 5, "unknown", "nfs4", False), ("ram", "/t", 10, 5, "unknown", "tmpfs", False), ("stick", "/u", 10, 5, "hdd", "vfat", True), ("plain", "/p", 10, 12, "unknown", "ext4", None)))
    got = {r["mount_point"]: r for r in d.collect()}
    assert got["/g"]["locality_class"] == "cloud_backed" and not got["/g"]["eligible_for_local_target"]
    assert got["/n"]["storage_type"] == "nvme" and got["/n"]["performance_class"] == "fast" and got["/n"]["vendor"] == "Samsung" and got["/n"]["eligible_for_local_target"]
    assert abs(got["/n"]["performance_rank"] - 3.68) < 1e-9
    assert got["/"]["is_os_drive"] and not got["/"]["eligible_for_local_target"]
    assert got["/nas"]["storage_type"] == "network" and got["/t"]["storage_type"] == "virtual" and got["/u"]["storage_type"] == "usb"
    assert got["/p"]["performance_class"] == "balanced" and got["/p"]["used_bytes"] == 0


def test_hints_win_and_fill(spark):
    h = spark.createDataFrame([(0, "/p", None, "Old", "sata", True, 0.7, "a"), (1, "/p", "WD", None, None, None, 0.9, "b")], "pos int, mount_point string, vendor string, model string, interface string, rotational boolean, confidence double, source string")
    m = disks.merge_hints(h)
    assert rows(m, "vendor", "model", "rotational", "confidence", "source") == [("WD", "Old", True, 0.9, "b")]
    d = disks.enrich(probe(spark, ("plain", "/p", 10, 5, "unknown", "ext4", False)), m)
    assert rows(d, "storage_type", "vendor", "interface", "rotational") == [("hdd", "WD", "sata", True)]


def test_interface_and_rotation_words(spark):
    df = spark.createDataFrame([("PCIe iSCSI",), ("NVMe",), ("virtio",), ("nfs",), (" ",)], "x string")
    assert [r[0] for r in df.select(s.interface(F.col("x"))).collect()] == ["sata", "nvme", "virtio", "network", None]
    df = spark.createDataFrame([("true",), ("0",), ("no",), ("2",), ("maybe",), (None,)], "x string")
    assert [r[0] for r in df.select(s.rotational(F.col("x"))).collect()] == [True, False, False, True, None, None]


def test_categories_and_roles(spark):
    p = spark.createDataFrame([("s", "/SteamLibrary", "/g", 10, 0, 0, 100), ("s", "/x", "/m", 10, 8, 0, 100)], "scan_id string, root_path string, disk_mount string, file_count bigint, stale_files bigint, recent_files bigint, type_total_bytes bigint")
    d = spark.createDataFrame([("s", "/x", "/x/DCIM", 5)], "scan_id string, root_path string, path string, size_bytes bigint")
    e = spark.createDataFrame([("s", "/x", "jpg", 60), ("s", "/x", "zip", 7)], "scan_id string, root_path string, extension string, bytes bigint")
    got = {(r["target"], r["category"]): r["confidence"] for r in classify.categorize_paths(p, d, e).collect()}
    assert got == {("/SteamLibrary", "games"): 0.8, ("/x", "media"): 1.0, ("/x", "archive"): 0.4}
    di = disks.enrich(probe(spark, ("Games", "/g", 10, 5, "ssd", "ext4", False), ("Photos", "/m", 10, 5, "hdd", "ext4", False), ("plain", "/z", 10, 5, "hdd", "ext4", False)))
    cats = classify.all_categories(p, d, e, di)
    role = {r["mount_point"]: r for r in classify.infer_roles(di, cats).collect()}
    assert role["/g"]["role"] == "games_library" and role["/m"]["role"] == "media_library" and role["/z"]["role"] == "unknown"
    assert role["/m"]["target_role_eligibility"] == ["media_library", "archive", "backup_target"] and len(role["/z"]["target_role_eligibility"]) == 7


def test_diff_is_antisymmetric_and_empty_on_itself(spark):
    cols = "mount_point string, name string, free_space_bytes bigint"
    left, right = spark.createDataFrame([("/a", "x", 5), ("/b", "y", 7), ("/same", "z", 1)], cols), spark.createDataFrame([("/a", "x2", 9), ("/c", "w", 0), ("/same", "z", 1)], cols)
    ab = {r["mount_point"]: r["free_space_delta_bytes"] for r in diff.disk_diff(left, right).collect()}
    ba = {r["mount_point"]: r["free_space_delta_bytes"] for r in diff.disk_diff(right, left).collect()}
    assert ab == {"/a": 4, "/b": -7, "/c": 0} and {k: -v for k, v in ba.items()} == ab
    assert diff.disk_diff(left, left).count() == 0


def test_recommendation_changes(spark):
    cols = "id string, confidence double, target_mount string, risk_level string, rationale string"
    left = spark.createDataFrame([("a", 0.5, None, "low", "r"), ("b", 0.5, "/x", "low", "r"), ("c", 0.5, None, "low", "r")], cols)
    right = spark.createDataFrame([("b", 0.7, None, "high", "q"), ("c", 0.5005, None, "low", "r"), ("d", 0.1, None, "low", "r")], cols)
    assert rows(diff.recommendation_changes(left, right), "id", "change") == [("a", "removed"), ("b", "confidence_changed"), ("b", "target_changed"), ("b", "risk_changed"), ("b", "rationale_changed"), ("d", "added")]


def test_growth_needs_two_snapshots_and_both_limits(spark):
    g = 1 << 30
    snap = lambda *r: spark.createDataFrame(list(r), "snap_pos int, generated_at string, mount_point string, total_space_bytes bigint, free_space_bytes bigint")
    one = snap((0, "2026-01-01T00:00:00Z", "/a", 100 * g, 90 * g))
    assert trend.disk_growth(one).count() == 0
    two = one.unionByName(snap((1, "2026-01-04T12:00:00Z", "/a", 100 * g, 70 * g), (1, "2026-01-04T12:00:00Z", "/new", 100 * g, 1 * g)))
    assert rows(trend.disk_growth(two), "id", "growth_bytes", "days") == [("disk-growth-a", 20 * g, 3)]
    assert trend.disk_growth(two.unionByName(snap((2, "bad", "/a", 100 * g, 69 * g)))).count() == 0
    assert rows(trend.disk_growth(two.unionByName(snap((2, "bad", "/a", 100 * g, 40 * g)))), "days") == [(0,)]


def test_policy(spark):
    r = spark.createDataFrame([("s", 0, "x", "/bad", []), ("s", 1, "x", None, ["p"]), ("s", 2, "x", None, []), ("s", 3, "active-workload-placement", "/cold", []), ("s", 4, "y", "/gone", []), ("s", 5, "z", "/ok", [])],
                              "scan_id string, pos bigint, id string, target_mount string, policy_rules_applied array<string>")
    d = spark.createDataFrame([("s", 0, "/bad", False, ["cloud"], "unknown"), ("s", 1, "/cold", True, [], "archive"), ("s", 2, "/ok", True, [], "mixed")],
                              "scan_id string, pos int, mount_point string, eligible_for_local_target boolean, ineligible_reasons array<string>, role string")
    out = policy.enforce(r, d)
    kept = out["recommendations"].orderBy("pos").collect()
    assert [(k["pos"], k["id"], k["policy_rules_applied"]) for k in kept] == [(1, "x", ["p", "safe_target_policy"]), (5, "z", ["safe_target_policy"])]
    assert sorted(rows(out["rejection_traces"], "rule_id", "recommendation_id")) == [("contradiction_detector", "x"), ("role_aware_target_policy", "active-workload-placement"), ("safe_target_policy", "x"), ("safe_target_policy", "y")]
    assert rows(out["contradictions"], "contradiction_count") == [(1,)]
    assert out["policy_decisions"].where("action = 'blocked'").count() == 4


def test_scenarios_have_three_rows_even_without_recommendations(spark):
    recs = spark.createDataFrame([("s", 0, "a", True, "low", None), ("s", 1, "b", True, "medium", 10), ("s", 2, "c", True, "high", 5), ("s", 3, "d", False, "low", 99)],
                                 "scan_id string, pos bigint, id string, policy_safe boolean, risk_level string, space_saving_bytes bigint")
    dec = spark.createDataFrame([("s", "d", "blocked"), ("s", "d", "blocked"), ("s", "a", "allowed")], "scan_id string, recommendation_id string, action string")
    scans = spark.createDataFrame([("s",), ("empty",)], "scan_id string")
    got = rows(scenario.plan(scans, recs, dec), "scan_id", "scenario_id", "recommendation_ids", "projected_space_saving_bytes", "blocked_recommendation_count")
    assert got == [("empty", "conservative", [], 0, 0), ("empty", "balanced", [], 0, 0), ("empty", "aggressive", [], 0, 0),
                   ("s", "conservative", ["a"], 0, 1), ("s", "balanced", ["a", "b"], 10, 1), ("s", "aggressive", ["a", "b", "c"], 15, 1)]


def test_evaluation(spark):
    recs = spark.createDataFrame([("1", 0, "a", True), ("1", 1, "b", True), ("1", 2, "c", True), ("1", 3, "d", True)], "scan_id string, pos bigint, id string, policy_safe boolean")
    cases = spark.createDataFrame([("one", "1", ["a", "d"], []), ("two", "1", [], ["c"]), ("three", "none", ["a"], [])], "name string, scan_id string, expected_top_ids array<string>, forbidden_ids array<string>")
    res = evaluate.case_results(cases, recs)
    got = {r["name"]: (round(r["precision_at_3"], 4), r["passed"]) for r in res.collect()}
    assert got == {"one": (0.3333, True), "two": (0.0, False), "three": (0.0, False)}
    assert rows(evaluate.quality_gate(evaluate.summary(res)), "total_cases", "passed_cases", "passed_gate") == [(3, 1, False)]


def test_filters_of_the_views(spark):
    g = spark.createDataFrame([("likely_redundant", "h1", [("/a/Photo.jpg",)]), ("likely_intentional", "h2", [("/b",)])], "intent string, hash string, files array<struct<path:string>>")
    assert rows(filters.search_duplicates(g, " photo"), "hash") == [("h1",)] and filters.search_duplicates(g, "").count() == 2
    t = spark.createDataFrame([("emitted", "a"), ("skipped", None), ("emitted", "b")], "status string, recommendation_id string")
    assert dict(rows(filters.trace_status_counts(t), "status", "traces")) == {"emitted": 2, "skipped": 1, "all": 3}
    assert filters.filter_traces(t, "emitted", "a").count() == 1


def test_events_batch_and_stream(spark, tmp_path):
    folder = str(tmp_path / "events")
    data = [(i, "s", p, None, i, i * 10, 0, "2026-01-01T00:00:00Z") for i, p in enumerate(("enumerating_disks", "walking_files", "walking_files", "done"), 1)]
    ev.append_events(spark, data, folder)
    e = spark.read.parquet(folder)
    assert rows(ev.poll(e, "s", 2), "seq") == [(3,), (4,)]
    assert rows(ev.progress_summary(e), "total_events", "completed") == [(4, True)]
    assert sorted(r[0] for r in rows(ev.tail(e, 2), "seq")) == [3, 4]
    q = ev.count_phases_live(ev.stream_events(spark, folder), "phases_test", str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert dict(rows(spark.table("phases_test"), "phase", "events")) == {"enumerating_disks": 1, "walking_files": 2, "done": 1}


def test_bytes_as_text(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 30,)], "n bigint")
    assert [r[0] for r in df.select(s.human_bytes(F.col("n"))).collect()] == ["0 B", "1023.0 B", "1.5 KB", "5.0 GB"]
    assert [r[0] for r in df.select(s.display_bytes(F.col("n"))).collect()] == ["n/a", "1023 B", "1.5 KB", "5.0 GB"]
    assert [r[0] for r in df.select(s.display_signed_bytes(-F.col("n"))).collect()] == ["0 B", "-1023 B", "-1.5 KB", "-5.0 GB"]


def test_mount_names_and_ids(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(s.windows_mount(F.lit(" d:"))) == "D:\\" and one(s.unix_mount(F.lit("/a/"))) == "/a" and one(s.unix_mount(F.lit("/"))) == "/"
    assert one(s.dashed_id(F.lit("F:\\"))) == "F--" and one(s.bare_id(F.lit("F:\\x"))) == "Fx"
    assert one(s.safe_stem(F.lit("ok-1"))) == "ok-1" and one(s.safe_stem(F.lit("../x"))).startswith("scan-") and one(s.safe_stem(F.lit("scan-x"))) != "scan-x"
    assert one(s.throughput_mb_s(F.lit(1048576.0), F.lit(500.0))) == 2.0 and one(s.throughput_mb_s(F.lit(1.0), F.lit(0.0))) == 0.0


def plain_rollup(rows_):
    out = {}
    for root, path, size in rows_:
        at = path
        while at.startswith(root) and at != root:
            at = at.rsplit("/", 1)[0] or "/"
            if at.startswith(root):
                n, b = out.get((root, at), (0, 0))
                out[root, at] = (n + 1, b + size)
            if at == "/":
                break
    return out


def test_rollup_by_levels(spark):
    import random

    r = random.Random(1)
    data = []
    for root in ("/r", "/r2/deep/root", "/"):
        for k in range(200):
            data.append((root, root.rstrip("/") + "".join(f"/{r.choice('ab')}" for _ in range(r.randrange(0, 7))) + f"/f{k}", r.randrange(100)))
    df = spark.createDataFrame([("s", *x) for x in data], "scan_id string, root_path string, path string, size_bytes bigint")
    got = {(x["root_path"], x["path"]): (x["files"], x["size_bytes"]) for x in usage.tree_rollup(df).collect()}
    assert got == plain_rollup(data)
    assert usage.tree_rollup(df.limit(0)).count() == 0
    drive = spark.createDataFrame([("s", "C:\\d", "C:\\d\\x\\f", 3), ("s", "C:/e", "C:/e/g", 4)], df.schema)
    assert {x["path"] for x in usage.tree_rollup(drive.where("root_path = 'C:/e'")).collect()} == {"C:/e"}


def test_rollup_shuffles_a_directory_once_at_any_depth(spark):
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        jobs = sc.statusStore().jobsList(None)
        ids = {jobs.apply(i).stageIds().apply(k) for i in range(jobs.size()) for k in range(jobs.apply(i).stageIds().size())}
        return {k: sc.statusStore().lastStageAttempt(k).shuffleWriteRecords() for k in ids}

    def shuffled(depth):
        before = written()
        data = [("s", "/r", "/r" + "/d" * depth + f"/f{k}", 1) for k in range(3000)]
        assert usage.tree_rollup(spark.createDataFrame(data, "scan_id string, root_path string, path string, size_bytes bigint")).count() == depth + 1
        return sum(n for k, n in written().items() if k not in before)

    assert shuffled(12) < 300  # exploding ancestors makes 3000 * 13 rows


def pairs_plainly(d):
    best = None
    for s_ in d:
        for t_ in d:
            hot, still = s_["_active"] > s_["_cold"] + 0.25, t_["_cold"] > t_["_active"] + 0.25
            if s_["mount_point"] != t_["mount_point"] and s_["used_bytes"] >= 50 and t_["free_space_bytes"] > int(s_["used_bytes"] * 1.25) and not (hot and still and t_["performance_rank"] <= s_["performance_rank"]):
                key = (-s_["used_bytes"], s_["pos"], t_["pos"])
                best = min(best, (key, s_["mount_point"], t_["mount_point"])) if best else (key, s_["mount_point"], t_["mount_point"])
    return best and best[1:]


def test_consolidation_sweep_equals_all_pairs(spark):
    import random

    from stowage.plans import rules

    r, data = random.Random(6), []
    for scan in range(120):
        for k in range(r.randrange(0, 9)):
            data.append((f"s{scan}", f"/m{k}", k, r.randrange(0, 300), r.randrange(0, 400), r.choice([0.1, 0.5, 0.5, 0.9]), r.choice([0.0, 0.3, 0.9]), r.choice([0.0, 0.3, 0.9])))
    df = spark.createDataFrame(data, "scan_id string, mount_point string, pos int, used_bytes bigint, free_space_bytes bigint, performance_rank double, _active double, _cold double")
    got = {x["scan_id"]: (x["s_mount_point"], x["t_mount_point"]) for x in rules.consolidation_pair(df, 50).collect()}
    want = {}
    for scan in {x[0] for x in data}:
        if p := pairs_plainly([dict(zip(df.columns, x, strict=True)) for x in data if x[0] == scan]):
            want[scan] = p
    assert got == want and len(want) > 60
    twice = df.where("scan_id = 's1'").withColumn("mount_point", F.lit("/m"))
    assert rules.consolidation_pair(twice, 50).count() == 0  # one mount is no pair


def test_files_of_a_group_are_rows(spark, monkeypatch):
    data = [("s", "/r", f"/r/{k:04}", 7, f"/m{k % 3}", None, "x", None, "h") for k in range(500)] + [("s", "/r", f"/q/{k}", 9, "/m", None, "x", None, f"g{k // 2}") for k in range(41)]
    df = spark.createDataFrame(data, FILE).repartition(7)
    g = duplicates.groups(df)
    children = duplicates.group_files(df, g)
    got = sorted(rows(duplicates.numbered(children), "hash", "path", "number"))
    assert got == sorted([("h", f"/r/{k:04}", k + 1) for k in range(500)] + [(f"g{k // 2}", f"/q/{k}", i + 1) for j in range(20) for i, k in enumerate(sorted((2 * j, 2 * j + 1), key=str))])
    few = {x["hash"]: x for x in duplicates.with_files(g, children, 3).collect()}
    assert [f["path"] for f in few["h"]["files"]] == ["/r/0000", "/r/0001", "/r/0002"] and few["h"]["more_files"] == 497 and few["g1"]["more_files"] == 0
    assert rows(filters.search_duplicates(g, "/0499", children), "hash") == [("h",)] and rows(g.where("hash = 'h'"), "first_file.path", "mounts") == [("/r/0000", 3)]
