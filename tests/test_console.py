"""What commands show, and what a user interface keeps."""

import json
import os

from stowage import cli, lines, service, workbench
from stowage.operators import duplicates
from stowage.sources import documents, filetree

from .test_reports import EXPECTED, SHAPES, category, disk, report


def said(capsys):
    return capsys.readouterr().out.splitlines()


def test_lines_of_commands(spark, tmp_path, capsys):
    f, store = tmp_path / "r.json", str(tmp_path / "s")
    f.write_text(json.dumps(SHAPES["risky"]))
    assert cli.main(["--lines", "plan", str(f)], spark) == 0
    out = said(capsys)
    assert len(out) == 3 and out[0].startswith("- conservative: 0 recommendations") and "aggressive: 1 recommendations" in out[2]
    assert cli.main(["--lines", "recommend", str(f), "--output", str(tmp_path / "o.json")], spark) == 0
    out = said(capsys)
    assert len(out) == 1 and out[0].startswith("- high risk, 0.82, safe: ") and json.loads((tmp_path / "o.json").read_text())["recommendations"]
    f.write_text(json.dumps(report("calm")))
    assert cli.main(["--lines", "recommend", str(f)], spark) == 0 and said(capsys) == [f"No recommendation for {f}."]
    assert cli.main(["--lines", "reports", "list", "--store", store], spark) == 0 and said(capsys) == ["No report is stored."]
    assert cli.main(["--lines", "reports", "import", str(f), "--store", store], spark) == 0 and said(capsys) == [f"calm is stored from {f}"]
    f.write_text(json.dumps(report("calm2", [disk("A\nB", "/a", 100, 40)], generated_at="2026-03-01T00:00:00Z", warnings=["w"])))
    cli.main(["--lines", "reports", "import", str(f), "--store", store], spark)
    said(capsys)
    cli.main(["--lines", "reports", "list", "--store", store], spark)
    assert said(capsys) == ["- calm2, 2026-03-01T00:00:00Z, roots , native, 1 warnings, 0 recommendations, imported", "- calm, 2026-02-11T00:00:00Z, roots , native, 0 warnings, 0 recommendations, imported"]
    cli.main(["--lines", "reports", "diff", "calm", "calm2", "--store", store], spark)
    assert said(capsys) == ["- /a: free +40 B"]
    cli.main(["--lines", "reports", "diff", "calm", "calm", "--store", store], spark)
    assert said(capsys) == ["The reports do not differ."]


def test_lines_of_a_suite_and_of_disks(spark, tmp_path, capsys):
    for k in ("risky", "games"):
        (tmp_path / f"{k}.json").write_text(json.dumps(SHAPES[k]))
    cases = [{"name": "good", "report": "risky.json", "expected_top_ids": EXPECTED["risky"], "forbidden_ids": []}, {"name": "worse", "report": "games.json", "expected_top_ids": ["x"], "forbidden_ids": EXPECTED["games"]}]
    (tmp_path / "suite.json").write_text(json.dumps({"cases": cases}))
    cli.main(["--lines", "eval", str(tmp_path / "suite.json")], spark)
    out = said(capsys)
    assert out[0].startswith("1 of 2 cases pass") and out[1] == "- pass good, 1.000 of the first three, forbidden: none" and out[2] == "- fail worse, 0.000 of the first three, forbidden: active-workload-placement"
    d = service.with_scans(documents.reports_from(spark, [report("d", [disk("A", "/a", 2048, 1024), disk("C", "/c", 10, 5, is_os_drive=True, eligible_for_local_target=False, ineligible_reasons=["os", "small"])])]))["disks"]
    assert lines.shown(lines.disk_lines(d)) == ["- A at /a: ssd, local_physical, 1.0 KB of 2.0 KB free", "- C at /c: ssd, local_physical, 5 B of 10 B free, system, no target: os; small"]


def test_a_loaded_report_is_not_narrowed(spark):
    dups = [{"size_bytes": 5, "hash": f"h{i}", "files": [{"path": f"/{p}/x", "disk_mount": "/"} for p in ("a", ("Photos", "old")[i])], "total_wasted_bytes": 5, "intent": {"label": "likely_redundant", "rationale": ""}} for i in range(2)]
    path = {"root_path": "/Data", "disk_mount": "/", "total_size_bytes": 1, "file_count": 1, "directory_count": 0, "largest_files": {"entries": []}, "largest_directories": [],
            "file_type_summary": {"top_extensions": [], "other_files": 0, "other_bytes": 0, "total_files": 0, "total_bytes": 0}, "activity": {"recent_files": 0, "stale_files": 0, "unknown_modified_files": 0}}
    reports = documents.reports_from(spark, [report("one", [disk("P", "F:\\", 1000, 25)], [path, path | {"root_path": "/else"}], [category("F:\\", "media", 0.95)], dups), report("two")])
    t = service.with_scans(reports)
    b = service.recommend(reports)
    t |= {"recommendations": b["recommendations"], "rule_traces": b["rule_traces"]}
    view = workbench.opened("one", b["recommendations"], " /x.json ")
    assert view == workbench.View("one", "/x.json", "risky-disk-F--") and workbench.opened("two", b["recommendations"]).recommendation_id is None
    whole = {k: v.count() for k, v in workbench.narrowed(view, t).items()}
    assert whole == {"paths": 2, "duplicate_groups": 2, "recommendations": 1, "rule_traces": 10}
    few = workbench.View("one", usage=" DATA", duplicates="photos", recommendations="nearly full", policy="blocked", trace_status="emitted")
    assert {k: v.count() for k, v in workbench.narrowed(few, t).items()} == {"paths": 1, "duplicate_groups": 1, "recommendations": 0, "rule_traces": 1}
    assert workbench.opened("one", b["recommendations"]).usage == ""


def test_record_of_one_file(tmp_path):
    (tmp_path / "f").write_text("abc")
    os.utime(tmp_path / "f", (1000, 1000))
    r = filetree.file_record(str(tmp_path / "f"), "/m")
    assert (r["size_bytes"], r["disk_mount"], r["modified"].timestamp(), r["path"]) == (3, "/m", 1000, str(tmp_path / "f"))


def test_a_report_holds_a_stated_number(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / "r" / f"d{k % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / f"d{k % 2}" / f"f{k}").write_text("same" if k < 4 else "twins")
    monkeypatch.setattr(service, "REPORT_FILES", 3)
    r = service.scan(spark, service.ScanOptions(roots=[str(tmp_path / "r")], dedupe_min_size=1), str(tmp_path / "s"), scan_id="few")
    assert [(len(g["files"]), g["more_files"], g["total_wasted_bytes"]) for g in r["duplicates"]] == [(3, 1, 12), (2, 0, 5)]
    kept = spark.read.parquet(str(tmp_path / "s" / "duplicates" / "few"))
    assert kept.count() == 6 and any("not all duplicates" in w for w in r["warnings"])
    groups = service.with_scans(documents.reports_from(spark, [r]))["duplicate_groups"]
    assert sorted(x["file_count"] for x in groups.collect()) == [2, 4] and duplicates.total_waste(groups).first()["wasted_bytes"] == 17
    assert service._said(spark.createDataFrame([(str(k),) for k in range(9)], "text string")) == [str(k) for k in range(9)]
    monkeypatch.setattr(service, "REPORT_WARNINGS", 2)
    assert service._said(spark.createDataFrame([(str(k % 9),) for k in range(20)], "text string")) == ["0", "1", "7 more warnings"]
