"""Commands: scan, recommend, doctor, eval, benchmark, parity, plan, diagnostics, reports list|import|show|diff."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import lines, service, sinks, workbench
from .plans import evaluate
from .sources import documents
from .tables import landed


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stowage")
    p.add_argument("--lines", action="store_true", help="show lines to read; JSON goes to --output")
    sub = p.add_subparsers(dest="command", required=True)

    def verb(name: str, *args) -> argparse.ArgumentParser:
        out = sub.add_parser(name)
        for a in args:
            out.add_argument(a)
        return out

    for name in ("scan", "benchmark", "parity"):
        v = verb(name)
        v.add_argument("roots", nargs="*")
        v.add_argument("--output")
        v.add_argument("--store")
        v.add_argument("--max-depth", type=int)
        v.add_argument("--exclude", action="append", default=[])
        v.add_argument("--no-dedupe", action="store_true")
        v.add_argument("--dedupe-min-size", type=int, default=1 << 20)
        v.add_argument("--iterations", type=int, default=3)
        v.add_argument("--cache", action="store_true")
        v.add_argument("--backend", choices=("native", "pdu_library", "pdu"), default="native")
    for name in ("recommend", "plan", "diagnostics"):
        v = verb(name, "report")
        v.add_argument("--output")
        v.add_argument("--markdown")
    verb("eval", "suite")
    verb("doctor")
    r = sub.add_parser("reports").add_subparsers(dest="action", required=True)
    for name, args in (("list", ()), ("import", ("path",)), ("show", ("scan_id",)), ("diff", ("left", "right"))):
        v = r.add_parser(name)
        for a in args:
            v.add_argument(a)
        v.add_argument("--store")
    return p


def _put(value, path: str | None, said: list[str] | None = None) -> None:
    """JSON to the path, or to the console where no lines are to be shown there."""
    for line in said or ():
        print(line)
    if said is not None and not path:
        return
    text = json.dumps(value, indent=2, default=str, ensure_ascii=False)
    if path:
        with open(path, "w") as f:
            f.write(text)
    else:
        print(text)


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in sinks.to_json(df)]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("scan", "benchmark", "parity"):
        opts = service.ScanOptions(roots=a.roots, max_depth=a.max_depth, excludes=a.exclude, dedupe=not a.no_dedupe, dedupe_min_size=a.dedupe_min_size, cache=a.cache, backend=a.backend)
        if a.command == "scan":
            report = service.scan(spark, opts, a.store)
            _put(report, a.output, lines.scan_lines(report) if a.lines else None)
        else:
            out = landed(service.parity(spark, opts) if a.command == "parity" else service.benchmark(spark, opts, a.iterations))
            _put(_rows(out), a.output, lines.shown((lines.parity_line if a.command == "parity" else lines.benchmark_line)(out)) if a.lines else None)
    elif a.command in ("recommend", "plan"):
        reports = documents.read_reports(spark, a.report)
        if a.command == "plan":
            out = landed(service.plan(reports))
            _put(_rows(out), a.output, lines.shown(lines.scenario_lines(out)) if a.lines else None)
        else:
            out = service.recommend(reports)
            said = (lines.shown(lines.recommendation_lines(out["recommendations"])) or [f"No recommendation for {a.report}."]) if a.lines else None
            _put({k: _rows(v.orderBy("pos") if "pos" in v.columns else v) for k, v in out.items()} if not a.lines or a.output else None, a.output, said)
            if a.markdown:
                with open(a.report) as f:
                    service.export_markdown(spark, json.load(f), a.markdown)
    elif a.command == "diagnostics":
        with open(a.report) as f:
            _put(service.diagnostics(spark, json.load(f)), a.output or workbench.diagnostics_path(a.report))
    elif a.command == "eval":
        suite = documents.read_suite(spark, a.suite)
        docs = []
        for c in suite.select("report").distinct().collect():
            with open(c[0]) as f:
                docs.append(json.load(f) | {"scan_id": os.path.abspath(c[0])})
        results, total = service.evaluate_cases(suite.withColumn("scan_id", F.col("report")), documents.reports_from(spark, docs))
        said = [*lines.shown(lines.summary_line(total)), *lines.shown(lines.case_lines(results))] if a.lines else None
        _put({"summary": _rows(evaluate.quality_gate(total)), "cases": _rows(results)}, None, said)
    elif a.command == "doctor":
        out = service.doctor(spark)
        said = [f"{out['os']} {out['arch']}, read only", *lines.shown(lines.disk_lines(service.own_disks(spark))), *out["notes"]] if a.lines else None
        _put(out, None, said)
    else:
        svc = service.Service(spark, workbench.store_folder(a.store))
        if a.action == "list":
            out = svc.list_reports()
            _put(out, None, (lines.shown(lines.report_lines(svc.store.table(spark))) or ["No report is stored."]) if a.lines else None)
        elif a.action == "import":
            out = svc.import_report(a.path)
            _put(out, None, [f"{out['scan_id']} is stored from {a.path}"] if a.lines else None)
        elif a.action == "show":
            _put(svc.get_report(a.scan_id), None)
        else:
            out = svc.compare_reports(a.left, a.right)
            said = [x for k, f in (("disk_diffs", lines.disk_diff_lines), ("path_diffs", lines.path_diff_lines), ("recommendation_changes", lines.change_lines)) for x in lines.shown(f(out[k]))] if a.lines else None
            _put({k: _rows(v) for k, v in out.items()}, None, (said or ["The reports do not differ."]) if a.lines else None)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
