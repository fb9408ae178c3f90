"""Scan, recommend, plan, evaluate, compare and export: the functions behind the commands."""

from __future__ import annotations

import json
import os
import platform
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import markdown, schemas
from .functions.scalars import top_directory
from .operators import classify, disks, duplicates, filters, mounts, usage
from .plans import diff, evaluate, policy, scenario, trend
from .sinks import History, ReportStore, ReportTable, ScanCache, file_stem
from .sources import devices, documents, filetree
from .sources.walk import Walk
from .streaming.sessions import Sessions
from .tables import landed, local_table, shared_folder

NOTES = ("Read-only: nothing is moved or removed.", "Classes are inferred, not measured.", "Cloud, network and virtual disks are no targets.")
ASSUMPTIONS = ("A what-if reckoning; no file is touched.", "Savings are the sum of the estimates of the recommendations included.", "No estimate counts as nothing.")


#: What a report holds at most: duplicate groups, files of each, warnings.  The store gets all duplicates as a table.
REPORT_GROUPS, REPORT_FILES, REPORT_WARNINGS = 5000, 100, 5000


@dataclass
class ScanOptions:
    roots: list[str] = field(default_factory=list)
    max_depth: int | None = None
    excludes: list[str] = field(default_factory=list)
    dedupe: bool = True
    dedupe_min_size: int = 1 << 20
    dry_run: bool = False
    backend: str = "native"
    progress: bool = False
    min_ratio: float | None = None
    emit_progress_events: bool = True
    progress_interval_ms: int = 250
    cache: bool = False
    cache_ttl_seconds: int = 900

    def check(self) -> None:
        filters.validate_options(self.min_ratio, self.progress_interval_ms, self.cache, self.cache_ttl_seconds)
        if self.backend not in ("native", "pdu_library", "pdu"):
            raise ValueError(f"no backend {self.backend!r}")


def now_text() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z")


def path_tables(spark: SparkSession, opts: ScanOptions, scan_id: str, as_of: datetime, enriched: DataFrame, tree: DataFrame) -> dict[str, DataFrame]:
    """What a walk says about its roots: files (lazy), paths and path_directories (worked out), path_extensions and
    path_largest_files, warnings."""
    named = local_table(spark, [(i, os.path.abspath(r)) for i, r in enumerate(opts.roots)], "pos int, root_path string")
    roots = landed(mounts.match_mounts(named, enriched.select("pos", "mount_point")))
    files = filetree.files_of(tree, scan_id).drop("disk_mount").join(F.broadcast(roots.select("root_path", "disk_mount")), "root_path")  # the roots named
    dirs = tree.where("kind = 'directory'").select(F.lit(scan_id).alias("scan_id"), "root_path", "path")
    total = usage.totals(files, F.lit(as_of.replace(tzinfo=None)).cast("timestamp"))
    directories = usage.top_directories(files)
    if opts.backend != "native" and not opts.excludes:
        rolled = usage.tree_rollup(files)
        root = rolled.where(F.col("path") == F.col("root_path")).select("scan_id", "root_path", F.col("size_bytes").alias("_size"))
        total = total.join(root, ["scan_id", "root_path"], "left").withColumn("total_size_bytes", F.coalesce("_size", F.lit(0))).drop("_size")
        first = F.col("path") == top_directory(F.concat("path", F.lit("/.")), F.col("root_path"))
        directories = usage.top(rolled.where(first).select("scan_id", "root_path", "path", "size_bytes"), usage.TOP_DIRECTORIES, F.desc("size_bytes"), "path")
    zero = ("file_count", "total_size_bytes", "recent_files", "stale_files", "unknown_modified_files", "directory_count")
    paths = roots.withColumn("scan_id", F.lit(scan_id)).join(total.drop("disk_mount"), ["scan_id", "root_path"], "left").join(usage.directory_counts(dirs), ["scan_id", "root_path"], "left")
    paths = landed(paths.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in zero}).withColumn("type_total_bytes", F.col("total_size_bytes")))
    warn = tree.where("kind = 'warning'").select(F.lit(scan_id).alias("scan_id"), "path", F.col("warning").alias("text"))
    return {"files": files, "paths": paths, "path_directories": landed(directories.join(paths.select("root_path", F.col("pos").alias("path_pos")), "root_path")),
            "path_extensions": usage.extension_summary(files), "path_largest_files": usage.largest_files(files), "warnings": warn}


def scan_tables(spark: SparkSession, opts: ScanOptions, scan_id: str, as_of: datetime, probes: DataFrame | None = None, hints: DataFrame | None = None, tree: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of one scan, from the walk (or a tree that was walked before) to the categories; files and duplicate
    groups stay lazy, what has a row a root, disk or retained directory is worked out.  With a backend other than native,
    and no excludes, the sizes of roots and directories come from the rollup of the whole tree; all else is the same."""
    probes = devices.probe_disks(spark, scan_id) if probes is None else probes
    # disks, roots, retained directories and suggestions are few rows that much is made from: each is worked out once
    enriched = landed(disks.enrich(probes, devices.platform_hints(spark) if hints is None else hints))
    walked = filetree.read_tree(spark, opts.roots, opts.max_depth, opts.excludes).persist() if tree is None else tree
    t = path_tables(spark, opts, scan_id, as_of, enriched, walked)
    files = t["files"]
    # only files whose size is not theirs alone are read for their hash, each path once
    own = filetree.hashed(duplicates.candidates(files.dropDuplicates(["scan_id", "path"]), opts.dedupe_min_size)).persist() if opts.dedupe else None
    named = files.drop("content_hash").join(own.select("path", "content_hash"), "path") if opts.dedupe else files.limit(0)
    groups = duplicates.groups(named, opts.dedupe_min_size).withColumn("pos", F.lit(0)).persist()  # ties go by what a group holds
    cats = landed(classify.all_categories(t["paths"], t["path_directories"], landed(usage.top_extensions(files)), enriched))
    roled = landed(classify.infer_roles(enriched, cats))
    warn = t["warnings"]
    if own is not None:
        warn = warn.unionByName(own.where("warning is not null").select(F.lit(scan_id).alias("scan_id"), "path", F.col("warning").alias("text")))
    return t | {"scans": local_table(spark, [(scan_id,)], "scan_id string"), "disks": roled, "categories": cats, "duplicate_groups": groups, "duplicate_files": duplicates.group_files(named, groups, opts.dedupe_min_size),
                "warnings": warn.drop("path").withColumn("pos", F.monotonically_increasing_id()), "_held": [x for x in (walked if tree is None else None, own, groups) if x is not None]}


def auto_roots(spark: SparkSession, probes: DataFrame) -> list[str]:
    """Every mount that is no pseudo file system, once whatever its case: the roots of a scan that names none."""
    none = local_table(spark, [], "pos int, path string")
    return [r["path"] for r in mounts.resolve_roots(none, probes).orderBy("pos").collect()]


def scan(spark: SparkSession, opts: ScanOptions, store: str | None = None, on_event=None, probes: DataFrame | None = None, hints: DataFrame | None = None, scan_id: str | None = None,
         cancelled=lambda: False) -> dict:
    """Runs a scan; returns the report document, which also goes to the store, the cache and the history.  Without roots
    all mounts are scanned.  A scan that is cancelled returns the roots that its walk has committed rows of, with a
    warning, and is neither cached nor part of the history.  One that fails leaves what it walked in the shared folder,
    and a scan of the same id, roots and limits goes on from there."""
    opts.check()
    scan_id, began, events = scan_id or uuid.uuid4().hex, time.time(), []

    def emit(phase: str, path: str | None = None, files: int = 0, bytes_: int = 0, errors: int = 0) -> None:
        events.append(phase)
        if on_event and opts.emit_progress_events:
            on_event({"phase": phase, "current_path": path, "scanned_files": files, "scanned_bytes": bytes_, "errors": errors, "timestamp": now_text()})

    emit("enumerating_disks")
    if not opts.roots:
        probes = devices.probe_disks(spark, scan_id) if probes is None else probes
        opts = ScanOptions(**{**asdict(opts), "roots": auto_roots(spark, probes)})
    key = {k: v for k, v in asdict(opts).items() if k not in ("cache", "cache_ttl_seconds")}
    cache = ScanCache(f"{store}/cache" if store else ".", opts.cache_ttl_seconds, opts.cache and store is not None)
    kept, _ = cache.get(key, opts.roots)
    if kept is not None:
        emit("done")
        return kept
    missing = [r for r in opts.roots if not os.path.exists(r)]
    here = list({os.path.abspath(r).lower(): r for r in reversed(opts.roots) if os.path.exists(r)}.values())[::-1]
    if not here:
        raise ValueError("no scan root exists")
    opts = ScanOptions(**{**asdict(opts), "roots": here})
    t: dict = {}
    as_of, over = datetime.now(UTC), True
    tour = Walk(spark, f"{shared_folder(spark)}/scan-{file_stem(scan_id)}", opts.roots, opts.max_depth, opts.excludes)
    try:
        emit("walking_files")
        walked = lambda root, files, bytes_, errors: emit("walking_files", root, files, bytes_, errors)
        tour.run(walked, walked if opts.emit_progress_events and on_event else None, opts.progress_interval_ms)
        emit("categorizing")
        t |= scan_tables(spark, opts, scan_id, as_of, probes, hints, tour.tree())
        path_rows = [r.asDict(recursive=True) for r in t["paths"].orderBy("pos").collect()]
        emit("dedupe")
        emit("analyzing")
        history = History(store) if store else None
        if history is not None and os.path.exists(history.path):
            t["disk_snapshots"], t["path_snapshots"] = trend.history_tables(documents.read_history(spark, history.path))
        return _finished(spark, opts, store, scan_id, t, path_rows, missing, events, emit, began, cache, key, here, history)
    except Exception:
        over = cancelled()
        if not over:
            raise
        begun = tour.begun()
        said = [f"scan canceled while walking {tour.at}; report contains partial data"] if tour.at in begun else []
        if tour.at is None or len(begun) < len(here):
            said.append("scan canceled by caller")
        probes = devices.probe_disks(spark, scan_id) if probes is None else probes
        kept = path_tables(spark, ScanOptions(**{**asdict(opts), "roots": [r for r in tour.roots if r in begun]}), scan_id, as_of, probes, tour.tree())
        return _partial(opts, scan_id, kept, [*_missing(missing), *said], events, began)
    finally:
        for df in t.get("_held", []):
            df.unpersist()
        if over:
            tour.remove()


def _missing(roots: list[str]) -> list[str]:
    return [f"root does not exist: {m}" for m in roots]


def _path(p: dict, **more) -> dict:
    return {"root_path": p["root_path"], "disk_mount": p["disk_mount"], "total_size_bytes": p["total_size_bytes"], "file_count": p["file_count"], "directory_count": p["directory_count"],
            **more, "activity": {k: p[k] for k in ("recent_files", "stale_files", "unknown_modified_files")}}


def _head(opts: ScanOptions, scan_id: str) -> dict:
    return {"report_version": schemas.REPORT_VERSION, "generated_at": now_text(), "scan_id": scan_id,
            "scan": {k: getattr(opts, k) for k in ("roots", "max_depth", "excludes", "dedupe", "dedupe_min_size", "dry_run", "backend", "progress", "min_ratio", "emit_progress_events", "progress_interval_ms")}}


def _metrics(opts: ScanOptions, path_rows: list[dict], warnings: list[str], contradictions: int, events: list[str], began: float, completed: bool) -> dict:
    return {"scan_metrics": {"backend": opts.backend, "elapsed_ms": int((time.time() - began) * 1000), "scanned_roots": len(path_rows), "scanned_files": sum(p["file_count"] for p in path_rows),
                             "scanned_directories": sum(p["directory_count"] for p in path_rows), "scanned_bytes": sum(p["total_size_bytes"] for p in path_rows),
                             "permission_denied_warnings": sum("permission" in w.lower() for w in warnings), "contradiction_count": contradictions},
            "scan_progress_summary": {"total_events": len(events), "phase_counts": [{"phase": p, "events": events.count(p)} for p in schemas.PHASES if p in events], "completed": completed}}


def _rows(df: DataFrame, *order) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def _said(warnings: DataFrame) -> list[str]:
    """Warnings by their text, each once, as many as a report holds, and how many more there are."""
    texts = warnings.select("text").distinct()
    some = [w["text"] for w in texts.orderBy("text").limit(REPORT_WARNINGS + 1).collect()]
    return some if len(some) <= REPORT_WARNINGS else [*some[:REPORT_WARNINGS], f"{texts.count() - REPORT_WARNINGS} more warnings"]


def _paths(t: dict[str, DataFrame], path_rows: list[dict]) -> list[dict]:
    """The roots of a report, with their largest files and directories and their extensions."""
    text = lambda d: d.isoformat(timespec="seconds") + "Z" if d else None
    ext = {r["root_path"]: r for r in _rows(t["path_extensions"], "root_path")}
    top_dirs, top_files = _rows(t["path_directories"], "root_path", "pos"), _rows(t["path_largest_files"], "root_path", "pos")
    none = {"top_extensions": [], "other_files": 0, "other_bytes": 0, "total_files": 0, "total_bytes": 0}
    return [_path(p, largest_files={"entries": [{"path": f["path"], "size_bytes": f["size_bytes"], "modified": text(f["modified_ts"])} for f in top_files if f["root_path"] == p["root_path"]]},
                  largest_directories=[{"path": x["path"], "size_bytes": x["size_bytes"]} for x in top_dirs if x["root_path"] == p["root_path"]],
                  file_type_summary={k: v for k, v in ext.get(p["root_path"], none).items() if k not in ("scan_id", "root_path")}) for p in path_rows]


def _partial(opts: ScanOptions, scan_id: str, t: dict[str, DataFrame], warnings: list[str], events: list[str], began: float) -> dict:
    path_rows = _rows(t["paths"], "pos")
    warnings = list(dict.fromkeys([*warnings, *_said(t["warnings"])]))
    out = _head(opts, scan_id) | {"disks": [], "paths": _paths(t, path_rows), "categories": [], "duplicates": [], "recommendations": [], "policy_decisions": [], "rule_traces": [], "warnings": warnings}
    return out | _metrics(opts, path_rows, warnings, 0, events, began, False)


def _finished(spark, opts: ScanOptions, store, scan_id: str, t: dict, path_rows: list[dict], missing, events, emit, began, cache, key, here, history) -> dict:
    bundle = policy.recommend({k: v for k, v in t.items() if k != "_held"}, small=True)
    emit("recommending")
    rows, text = _rows, lambda d: d.isoformat(timespec="seconds") + "Z" if d else None
    warnings = list(dict.fromkeys([*_missing(missing), *_said(t["warnings"]), *filters.Excludes(opts.excludes).warnings]))  # each once
    first = landed(t["duplicate_groups"].orderBy(*duplicates.by_waste()).limit(REPORT_GROUPS + 1))
    shown = duplicates.with_files(first.orderBy(*duplicates.by_waste()).limit(REPORT_GROUPS), t["duplicate_files"], REPORT_FILES)
    dups = rows(shown, *duplicates.by_waste())
    if store and (first.count() > REPORT_GROUPS or any(g["more_files"] for g in dups)):
        path = f"{os.path.abspath(store)}/duplicates/{file_stem(scan_id)}"
        duplicates.numbered(t["duplicate_files"]).write.mode("overwrite").parquet(path)
        warnings.append(f"not all duplicates are listed; {path} holds all")
    contradictions = sum(r["contradiction_count"] for r in bundle["contradictions"].collect())
    report = {
        **_head(opts, scan_id),
        "disks": [{**{k: v for k, v in d.items() if k not in ("scan_id", "pos", "role", "role_confidence", "role_evidence", "performance_rank", "used_bytes", *schemas.CATEGORIES)},
                   "role_hint": {"role": d["role"], "confidence": d["role_confidence"], "evidence": d["role_evidence"]}} for d in rows(t["disks"], "mount_point")],
        "paths": _paths(t, path_rows),
        "categories": [{**{k: c[k] for k in ("target", "disk_mount", "category", "confidence", "evidence")}, "rationale": "; ".join(c["evidence"])} for c in rows(t["categories"], "pos")],
        "duplicates": [{"size_bytes": g["size_bytes"], "hash": g["hash"], "files": [{**f, "modified": text(f["modified"])} for f in g["files"]], "more_files": g["more_files"],
                        "total_wasted_bytes": g["total_wasted_bytes"], "intent": {"label": g["intent"], "rationale": ""}} for g in dups],
        "recommendations": [_document(r) for r in rows(bundle["recommendations"], "pos")],
        "policy_decisions": [{k: d[k] for k in ("policy_id", "recommendation_id", "action", "rationale")} for d in rows(bundle["policy_decisions"], "pos", "k")],
        "rule_traces": [{k: r[k] for k in ("rule_id", "status", "detail", "recommendation_id", "confidence")} for r in rows(bundle["rule_traces"], "pos")],
        "warnings": warnings,
    }
    emit("done")
    report |= _metrics(opts, path_rows, warnings, contradictions, events, began, True)
    if store:
        if (w := cache.put(key, here, report)) is not None:
            report["warnings"].append(w)
        history.append(report)
        ReportStore(store).put(report)
    return report


def _document(r: dict) -> dict:
    keep = ("id", "title", "rationale", "confidence", "target_mount", "policy_safe", "policy_rules_applied", "policy_rules_blocked", "evidence", "next_steps", "risk_level")
    return {k: r[k] for k in keep} | {"estimated_impact": {k: r[k] for k in ("space_saving_bytes", "performance", "risk_notes")}}


def with_scans(reports: DataFrame) -> dict[str, DataFrame]:
    """Tables of stored reports, ready for the rules: rank and used space of each disk as the rules need them."""
    t = schemas.tables(reports)
    rank = disks.performance_rank(F.col("performance_class"), F.col("storage_type"), F.col("performance_confidence"))
    t["disks"] = t["disks"].withColumns({"performance_rank": rank, "used_bytes": F.greatest(F.col("total_space_bytes") - F.col("free_space_bytes"), F.lit(0))})
    t["scans"] = reports.select("scan_id")
    return t


def recommend(reports: DataFrame, history: DataFrame | None = None) -> dict[str, DataFrame]:
    t = with_scans(reports)
    if history is not None:
        t["disk_snapshots"], t["path_snapshots"] = trend.history_tables(history)
    return policy.recommend(t)


def plan(reports: DataFrame, fresh: bool = True) -> DataFrame:
    """Scenarios over newly made recommendations, or over those that the reports hold."""
    if fresh:
        b = recommend(reports)
        return scenario.plan(reports.select("scan_id"), b["recommendations"], b["policy_decisions"])
    t = schemas.tables(reports)
    return scenario.plan(reports.select("scan_id"), t["recommendations"], t["policy_decisions"])


def evaluate_cases(cases: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cases: name, scan_id, expected_top_ids, forbidden_ids.  Results by case, and their summary."""
    b = recommend(reports)
    results = evaluate.case_results(cases, b["recommendations"], b["contradictions"])
    return results, evaluate.summary(results)


def compare(left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    return diff.report_diff(schemas.tables(left), schemas.tables(right))


def own_disks(spark: SparkSession) -> DataFrame:
    return disks.enrich(devices.probe_disks(spark, "doctor"), devices.platform_hints(spark))


def doctor(spark: SparkSession) -> dict:
    rows = [r.asDict() for r in own_disks(spark).orderBy("mount_point").collect()]
    return {"os": platform.system().lower(), "arch": platform.machine(), "current_dir": os.getcwd(), "os_mount": "/", "read_only_mode": True, "disks": rows,
            "notes": [*NOTES, *(["No disk was found."] if not rows else [])]}


def diagnostics(spark: SparkSession, report: dict) -> dict:
    return {"generated_at": now_text(), "report": report, "doctor": doctor(spark), "environment": {"os": platform.system().lower(), "arch": platform.machine(), "version": schemas.REPORT_VERSION}}


def export_markdown(spark: SparkSession, report: dict, path: str) -> str:
    text = markdown.render(schemas.tables(documents.reports_from(spark, [report])), report.get("scan_id") or "unknown", report["generated_at"])
    with open(path, "w") as f:
        f.write(text)
    return path


def parity(spark: SparkSession, opts: ScanOptions) -> DataFrame:
    """Totals of a scan by the direct sums and by the tree rollup, and whether they agree."""
    def timed(make) -> DataFrame:
        began = time.time()
        row = make().first()
        return spark.createDataFrame([("parity", row["f"] or 0, row["b"] or 0, int((time.time() - began) * 1000))], "scan_id string, scanned_files bigint, scanned_bytes bigint, elapsed_ms bigint")

    files = filetree.files_of(filetree.read_tree(spark, opts.roots, opts.max_depth, opts.excludes), "parity")
    native = timed(lambda: files.agg(F.count(F.lit(1)).alias("f"), F.sum("size_bytes").alias("b")))
    rolled = usage.tree_rollup(files).where(F.col("path") == F.col("root_path"))
    return usage.parity(native, timed(lambda: rolled.agg(F.sum("files").alias("f"), F.sum("size_bytes").alias("b"))))


def benchmark(spark: SparkSession, opts: ScanOptions, iterations: int = 3) -> DataFrame:
    rows = []
    for _ in range(iterations):
        r = scan(spark, opts)["scan_metrics"]
        rows.append((opts.backend, r["elapsed_ms"], r["scanned_files"], r["scanned_bytes"]))
    return usage.benchmark(spark.createDataFrame(rows, "backend string, elapsed_ms bigint, files bigint, bytes bigint"))


class Service:
    """Sessions and the store behind one object, as a user interface needs them."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store, self.sessions = spark, ReportStore(store), Sessions(spark)
        self.folder = store
        self.table = ReportTable(spark, store)

    def store_reports(self, reports: DataFrame) -> str:
        """Many reports at once (REPORT_SCHEMA), written by the executors."""
        return self.table.put(reports)

    def report_index(self) -> DataFrame:
        return self.table.index()

    def start_scan(self, opts: ScanOptions, **kw) -> str:
        return self.sessions.start(lambda scan_id, emit, cancelled: scan(self.spark, opts, self.folder, emit, scan_id=scan_id, cancelled=cancelled, **kw))

    def poll_scan_events(self, scan_id: str, from_seq: int = 0) -> list[dict]:
        return self.sessions.events(scan_id, from_seq)

    def cancel_scan(self, scan_id: str) -> bool:
        return self.sessions.cancel(scan_id)

    def get_scan_session(self, scan_id: str) -> dict:
        return self.sessions.get(scan_id)

    def follow(self, scan_id: str, from_seq: int = 0, every: float = 0.5, seconds: float = 3600):
        """The events of a scan as they come, polled every half second from the last one seen, until the scan is over."""
        until = time.time() + seconds
        while time.time() < until:
            over = self.sessions.get(scan_id)["status"] != "running"
            for e in self.sessions.events(scan_id, from_seq):
                from_seq = e["seq"]
                yield e
            if over:
                return
            time.sleep(every)

    def load_report(self, path: str) -> dict:
        with open(path) as f:
            return json.load(f)

    def list_reports(self) -> list[dict]:
        return self.store.list()

    def get_report(self, scan_id: str) -> dict:
        return self.store.get(scan_id)

    def import_report(self, path: str) -> dict:
        return self.store.import_file(path)

    def _table(self, report: dict) -> DataFrame:
        return documents.reports_from(self.spark, [report])

    def compare_reports(self, left: str, right: str) -> dict[str, DataFrame]:
        return compare(self._table(self.get_report(left)), self._table(self.get_report(right)))

    def generate_recommendations_from_report(self, report: dict) -> dict[str, DataFrame]:
        return recommend(self._table(report))

    def plan_scenarios_from_report(self, report: dict) -> DataFrame:
        return plan(self._table(report), fresh=False)

    def doctor(self) -> dict:
        return doctor(self.spark)

    def export_diagnostics_bundle(self, report: dict, path: str) -> str:
        with open(path, "w") as f:
            json.dump(diagnostics(self.spark, report), f, indent=2, default=str)
        return path

    def export_markdown_summary(self, report: dict, path: str) -> str:
        return export_markdown(self.spark, report, path)

    def export_report_diff(self, left: str, right: str, path: str) -> str:
        out = {k: [json.loads(x) for x in v.toJSON().collect()] for k, v in self.compare_reports(left, right).items()}
        with open(path, "w") as f:
            json.dump(out, f, indent=2)
        return path
