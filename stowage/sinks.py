"""Report store, history and scan cache.  Documents of one machine live beside each other as JSON; many reports are a
table (ReportTable).  Store folders are arguments, there is no hidden default."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas
from .tables import Commits

PREFIX = "scan-"


def file_stem(scan_id: str) -> str:
    if re.fullmatch(r"[A-Za-z0-9_-]+", scan_id) and not scan_id.startswith(PREFIX):
        return scan_id
    return PREFIX + hashlib.sha256(scan_id.encode()).hexdigest()


def _save(path: str, value) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    new = f"{path}.new"
    with open(new, "w") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(new, path)


def _load(path: str, default):
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return default


class ReportStore:
    def __init__(self, folder: str):
        self.folder = os.path.abspath(folder)
        self.index = f"{self.folder}/index.json"

    def path(self, scan_id: str) -> str:
        return f"{self.folder}/reports/{file_stem(scan_id)}.json"

    def _inside(self, path: str) -> bool:
        base = os.path.realpath(f"{self.folder}/reports")
        return os.path.exists(path) and os.path.commonpath([base, os.path.realpath(path)]) == base

    def _entries(self) -> list[dict]:
        """Index entries whose report exists inside the store, each with its path there."""
        out = []
        for e in _load(self.index, []):
            for p in (e.get("stored_report_path") or "", self.path(e["scan_id"])):
                if p and self._inside(p):
                    out.append(e | {"stored_report_path": os.path.realpath(p)})
                    break
        return out

    def put(self, report: dict, source: str | None = None, imported: bool = False) -> dict:
        scan_id = report.get("scan_id") or "unknown"
        path = self.path(scan_id)
        _save(path, report)
        scan = report.get("scan") or {}
        entry = {"scan_id": scan_id, "generated_at": report["generated_at"], "report_version": report["report_version"], "roots": scan.get("roots", []),
                 "backend": scan.get("backend") or "native", "warnings_count": len(report.get("warnings", [])), "recommendation_count": len(report.get("recommendations", [])),
                 "stored_report_path": os.path.realpath(path), "source_path": source, "imported": imported}
        rest = [e for e in self._entries() if e["scan_id"] != scan_id]
        _save(self.index, sorted([*rest, entry], key=lambda e: e["generated_at"], reverse=True))
        return entry

    def import_file(self, path: str) -> dict:
        """Stores a report from elsewhere as it is."""
        with open(path) as f:
            return self.put(json.load(f), source=os.path.abspath(path), imported=True)

    def list(self) -> list[dict]:
        entries = sorted(self._entries(), key=lambda e: e["generated_at"], reverse=True)
        if entries != _load(self.index, []):
            _save(self.index, entries)
        return entries

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(e[f.split()[0]] for f in schemas.INDEX_SCHEMA.split(", ")) for e in self.list()], schemas.INDEX_SCHEMA)

    def get(self, scan_id: str) -> dict:
        for p in (self.path(scan_id), f"{self.folder}/reports/{scan_id}.json"):
            if self._inside(p):
                return _load(p, None)
        raise KeyError(f"no report of scan {scan_id!r}")


class ReportTable:
    """Reports as a table of commits: rows are written by the executors, and a put is seen when all of it is there.  Two
    writers at once lose nothing, since each adds a commit of its own; of several reports of a scan the last put counts.
    Removal is a put too.  A report is one row or more: lists of over PIECE entries go on in further rows, so neither a row
    nor a batch of rows that is read grows with them.  Each row says how long its lists are; index() and snapshots() read
    only the columns they need, and no list for its length."""

    #: Entries of each list that one row holds.
    PIECE = 64
    LISTS = ("disks", "paths", "categories", "duplicates", "recommendations", "policy_decisions", "rule_traces", "warnings")
    #: copy: one report of a put; part, piece: the order of its rows.
    SCHEMA = ("put string, removed boolean, imported boolean, source_path string, copy string, part bigint, piece bigint, warnings_count bigint, "
              f"recommendation_count bigint, {schemas.REPORT_SCHEMA}")
    KEY = ("scan_id", "put", "copy", "part", "piece")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Commits(spark, f"{folder}/report_table", self.SCHEMA)

    @staticmethod
    def _name() -> str:
        return f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}"  # by time, and no two alike

    def _write(self, rows: DataFrame, removed: bool, imported: bool, source: str | None) -> str:
        name = self._name()
        head = {"put": F.lit(name), "removed": F.lit(removed), "imported": F.lit(imported), "source_path": F.lit(source).cast("string")}
        # rows without a part are a report each; rows with one are the report of their scan
        rows = rows.withColumns({"copy": F.lit("")} if "part" in rows.columns else {"copy": F.uuid(), "part": F.lit(0).cast("bigint")})
        fields = StructType.fromDDL(schemas.REPORT_SCHEMA)
        rows = rows.select("copy", "part", *(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        lists, others = self.LISTS, [f.name for f in fields if f.name not in self.LISTS]
        longest = F.greatest(F.lit(1), *(F.coalesce(F.size(n), F.lit(0)) for n in lists))
        last = F.floor((longest - 1) / self.PIECE)
        cut = lambda i: F.struct(i.alias("piece"), *(F.slice(n, i.cast("int") * self.PIECE + 1, self.PIECE).alias(n) for n in lists))
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("piece"), *lists))
        rows = rows.select("copy", "part", *others, F.inline(F.when(longest > self.PIECE, F.transform(F.sequence(F.lit(0).cast("bigint"), last), cut)).otherwise(whole)))
        counts = {"warnings_count": F.size("warnings"), "recommendation_count": F.size("recommendations")}
        rows = rows.withColumns(head | {k: F.coalesce(v, F.lit(0)).cast("bigint") for k, v in counts.items()})
        self.log.append(rows.to(StructType.fromDDL(self.SCHEMA)), name)
        return name

    def put(self, reports: DataFrame, imported: bool = False, source: str | None = None) -> str:
        """reports: REPORT_SCHEMA (missing columns are null), one row a report; with a column `part` (bigint), a report may
        come in several rows of its scan, whose lists go together by part and whose other fields are those of the first.
        The name of the put."""
        return self._write(reports.withColumn("scan_id", F.coalesce("scan_id", F.lit("unknown"))), False, imported, source)

    def remove(self, scans: DataFrame) -> str:
        """scans: scan_id."""
        return self._write(scans.select("scan_id").distinct(), True, False, None)

    def _last(self, rows: DataFrame) -> DataFrame:
        """Rows that no later put replaces: of each scan the last put (and one copy of it), by an anti-join with those it
        replaces."""
        last = rows.groupBy("scan_id").agg(F.max(F.struct("put", "copy")).alias("_last"))
        older = last.select(F.col("scan_id").alias("_scan"), "_last")
        kept = rows.join(older, (F.col("scan_id") == F.col("_scan")) & (F.struct("put", "copy") < F.col("_last")), "left_anti").where(~F.col("removed"))
        return kept.dropDuplicates(list(self.KEY))  # a compaction that is under way, or was lost, holds rows twice

    def current(self) -> DataFrame:
        """The present reports, one a scan, with their whole lists: what is long is better read by rows()."""
        rows = self.rows()
        fields = [f.name for f in StructType.fromDDL(schemas.REPORT_SCHEMA)]
        # pieces in order; a list that is null in all of them is null
        got = F.array_sort(F.collect_list(F.struct("part", "piece", *self.LISTS)))
        first = [F.min_by(n, F.struct("part", "piece")).alias(n) for n in fields if n not in self.LISTS and n != "scan_id"]
        whole = rows.groupBy("scan_id").agg(*first, got.alias("_rows"))
        joined = lambda n: F.flatten(F.filter(F.transform("_rows", lambda r: r[n]), lambda x: x.isNotNull()))
        some = lambda n: F.exists("_rows", lambda r: r[n].isNotNull())
        return whole.select(*(F.when(some(n), joined(n)).alias(n) if n in self.LISTS else F.col(n) for n in fields))

    def rows(self) -> DataFrame:
        """The present reports as they are stored: of each one row or more (part, piece), lists in pieces."""
        return self._last(self.log.read()).drop("put", "removed", "imported", "source_path", "copy", "warnings_count", "recommendation_count")

    def index(self) -> DataFrame:
        """One row a scan, of INDEX_SCHEMA; stored_report_path is the put's folder."""
        rows = self.log.read().select("removed", *self.KEY, "generated_at", "report_version", F.col("scan.roots").alias("roots"), F.coalesce("scan.backend", F.lit("native")).alias("backend"),
                                      "warnings_count", "recommendation_count", F.concat(F.lit(f"{self.log.folder}/"), "put").alias("stored_report_path"), "source_path", "imported")
        names = [f.split()[0] for f in schemas.INDEX_SCHEMA.split(", ")]
        made = [F.sum(n).alias(n) if n in ("warnings_count", "recommendation_count") else F.min_by(n, F.struct("part", "piece")).alias(n) for n in names[1:]]
        return self._last(rows).groupBy("scan_id").agg(*made).select(*names)

    def get(self, scan_id: str) -> DataFrame:
        return self.current().where(F.col("scan_id") == scan_id)

    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """disk_snapshots and path_snapshots of all present reports, numbered by their time of generation."""
        rows = self._last(self.log.read().select("removed", *self.KEY, "generated_at", "disks", "paths"))
        order = F.row_number().over(W.orderBy("generated_at", "scan_id"))
        heads = rows.groupBy("scan_id").agg(F.min_by("generated_at", F.struct("part", "piece")).alias("generated_at"))
        pos = heads.withColumn("snap_pos", order - 1).select("scan_id", "snap_pos", "generated_at")  # a row a report, three short columns
        rows = rows.drop("generated_at").join(pos, "scan_id")
        d = rows.select("snap_pos", "scan_id", "generated_at", F.explode("disks").alias("d")).select("snap_pos", "scan_id", "generated_at", "d.mount_point", "d.total_space_bytes", "d.free_space_bytes")
        p = rows.select("snap_pos", "scan_id", "generated_at", F.explode("paths").alias("p")).select("snap_pos", "scan_id", "generated_at", "p.root_path", "p.total_size_bytes", "p.file_count")
        return d, p

    def compact(self) -> None:
        """What is present now becomes one commit, and the commits that it was read from go; what others put meanwhile
        stays.  Their puts keep their names, so a later put still wins.  The oldest commits go first, so one that was lost
        brings back nothing that was removed.  One compaction runs at a time."""
        names = self.log.names()
        if len(names) < 2:
            return
        rows = self._last(self.log.read(names))
        self.log.append(rows, names[-1] + "-all")
        self.log.drop(names)

    def orphans(self, listing: DataFrame) -> DataFrame:
        """Entries of a listing (path) that no present report names: what a clean-up may delete."""
        return listing.join(self.index().select(F.col("stored_report_path").alias("path")), "path", "left_anti")


class History:
    """The snapshots of earlier scans, appended to."""

    def __init__(self, folder: str):
        self.path = f"{os.path.abspath(folder)}/history.json"

    def append(self, report: dict) -> None:
        h = _load(self.path, {"snapshots": []})
        h["snapshots"].append({
            "scan_id": report["scan_id"], "generated_at": report["generated_at"],
            "disks": [{k: d[k] for k in ("mount_point", "total_space_bytes", "free_space_bytes")} for d in report["disks"]],
            "paths": [{k: p[k] for k in ("root_path", "total_size_bytes", "file_count")} for p in report["paths"]]})
        _save(self.path, h)


class ScanCache:
    """Whole reports by a digest of the options that shape them; a hit needs the age and the roots' times to fit."""

    VERSION = 1

    def __init__(self, folder: str, ttl_seconds: int = 900, enabled: bool = True):
        self.folder, self.ttl, self.enabled = os.path.abspath(folder), ttl_seconds, enabled

    @staticmethod
    def signatures(roots: list[str]) -> list[dict]:
        return [{"path": r.replace("\\", "/"), "exists": os.path.exists(r), "modified_unix_secs": int(os.stat(r).st_mtime) if os.path.exists(r) else None} for r in sorted(roots)]

    def path(self, key: dict) -> str:
        return f"{self.folder}/{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()}.json"

    def get(self, key: dict, roots: list[str], now: datetime | None = None) -> tuple[dict | None, str]:
        """The report, or None, and why: hit, disabled, not_found, bad_json, key_mismatch, expired or changed."""
        if not self.enabled:
            return None, "disabled"
        try:
            entry = _load(self.path(key), None)
        except (OSError, ValueError):
            return None, "bad_json"
        if entry is None:
            return None, "not_found"
        if entry.get("schema_version") != self.VERSION or entry.get("key") != key:
            return None, "key_mismatch"
        try:
            created = datetime.fromisoformat(entry["created_at"])
        except ValueError:
            return None, "expired"
        if max(int((now or datetime.now(UTC)).timestamp()) - int(created.timestamp()), 0) > self.ttl:  # whole seconds
            return None, "expired"
        return (entry["report"], "hit") if entry["root_signatures"] == self.signatures(roots) else (None, "changed")

    def put(self, key: dict, roots: list[str], report: dict, now: datetime | None = None) -> str | None:
        """Returns a warning, or None.  A scan that was canceled is not kept."""
        if not self.enabled or any("scan canceled" in w for w in report.get("warnings", [])):
            return None
        try:
            _save(self.path(key), {"schema_version": self.VERSION, "key": key, "created_at": (now or datetime.now(UTC)).isoformat(timespec="seconds"),
                                   "root_signatures": self.signatures(roots), "report": report})
        except OSError as e:
            return f"the cache could not be written: {e}"
        return None


def to_json(df: DataFrame) -> list[str]:
    """A result table as JSON lines, for the small documents that commands write."""
    return [r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
