"""Disk probes of this machine, and hints about devices from captured JSON, which the engine takes apart."""

from __future__ import annotations

import os
import platform
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import media_rotational, optional, rotational
from ..tables import landed, local_table

PROBE = "pos int, name string, mount_point string, total_space_bytes bigint, free_space_bytes bigint, disk_kind string, file_system string, is_removable boolean"
HINT = "pos int, mount_point string, vendor string, model string, interface string, rotational boolean, confidence double, source string"


def probe_disks(spark: SparkSession, scan_id: str, mounts_file: str = "/proc/mounts") -> DataFrame:
    rows = []
    if os.path.exists(mounts_file):
        with open(mounts_file) as f:
            for line in f:
                device, mount, fs = line.split()[:3]
                mount = mount.replace("\\040", " ")
                try:
                    s = os.statvfs(mount)
                except OSError:
                    continue
                rows.append((len(rows), device, mount, s.f_frsize * s.f_blocks, s.f_frsize * s.f_bavail, "unknown", fs, False))
    return local_table(spark, rows, PROBE).withColumn("scan_id", F.lit(scan_id))


#: Rows of HINT and the document that they come from.
DOCUMENT_HINT = f"doc string, {HINT}"

_OWN = ("vendor", "model", "tran", "rota")
_SAYS = ", ".join(f"{c}: string" for c in _OWN)
#: Levels of a tree that get a column each; those below them are met within a row.
_READ = 3
_NODE = f"place: array<int>, mounts: array<string>, {_SAYS}"
#: What the levels of a tree have given, and the nodes of the next one, whose children are still to be read.
_LEVELS = f"struct<given: array<array<struct<{_NODE}>>>, nodes: array<struct<{_NODE}, children: variant>>>"


def _list(levels: int) -> str:
    """A list of devices with all fields by one cast, since a path that a device lacks costs the engine an exception."""
    return f"array<struct<{_SAYS}, mountpoint: string, mountpoints: array<string>, children: {_list(levels - 1) if levels > 1 else 'variant'}>>"


_CIM = """
WITH parsed AS (SELECT doc, try_parse_json(text) AS v FROM {docs})
SELECT doc, 0 AS pos, v AS node FROM parsed WHERE schema_of_variant(v) LIKE 'OBJECT%'
UNION ALL SELECT doc, pos, value FROM parsed, LATERAL variant_explode(v) AS t(pos, key, value) WHERE key IS NULL
"""


def _mounts(n: Column) -> Column:
    return F.concat(F.array(n["mountpoint"]), F.coalesce(n["mountpoints"], F.array().cast("array<string>")))


def _says(n: Column, c: str) -> Column:
    return F.nullif(F.trim(n[c]), F.lit(""))


def _children(above: Column) -> Column:
    """The nodes below a node, each with its place there, its mounts and what it or those above it say."""
    def device(n: Column, i: Column) -> Column:
        return F.struct(F.concat(above["place"], F.array(i)).alias("place"), _mounts(n).alias("mounts"), *(F.coalesce(_says(n, c), above[c]).alias(c) for c in _OWN), n["children"].alias("children"))

    return F.transform(F.coalesce(F.try_variant_get(above["children"], "$", _list(1)), F.array().cast(_list(1))), device)


def _next_level(at: Column) -> Column:
    given = F.transform(at["nodes"], lambda n: F.struct(*(n[c].alias(c) for c in ("place", "mounts", *_OWN))))
    return F.when(F.size(at["nodes"]) == 0, at).otherwise(F.struct(F.concat(at["given"], F.array(given)).alias("given"), F.flatten(F.transform(at["nodes"], _children)).alias("nodes")))


def _all_below(node: Column) -> Column:
    """All nodes below one, in the order of the document."""
    first = F.struct(F.array().alias("given"), _children(node).alias("nodes")).cast(_LEVELS)
    steps = F.sequence(F.lit(1), F.greatest(_nesting(F.to_json(node["children"])), F.lit(1)))
    return F.aggregate(steps, first, lambda at, _: _next_level(at), lambda at: F.sort_array(F.flatten(at["given"])))


def _nesting(text: Column) -> Column:
    """How many lists lie within each other at most in a JSON text: its brackets outside of strings, added up."""
    bare = F.replace(F.replace(text, F.lit("\\\\")), F.lit('\\"'))  # now each quote begins or ends a string
    outside = F.array_join(F.filter(F.split(bare, '"'), lambda _, i: i % 2 == 0), "")
    turns = F.split(F.regexp_replace(outside, r"[^\[\]]", ""), "")

    def turn(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), turn, lambda at: at["most"])


def lsblk_rows(docs: DataFrame) -> DataFrame:
    """docs: doc, text of `lsblk -J`.  Rows of DOCUMENT_HINT: one for each mount of each device, where children take over
    what their parents say.  A tree is flattened in one pass over its row: the upper levels are exploded, and a device goes
    with the first of its children; what lies below them, at any depth, is met level by level within the row.  pos is the
    order of the document.  What is no such document gives no rows."""
    t = docs.select("doc", F.posexplode(F.try_variant_get(F.try_parse_json("text"), "$.blockdevices", _list(_READ))).alias("_i0", "_n"))
    for k in range(_READ):
        n = F.col("_n")
        said = [(_says(n, c) if k == 0 else F.coalesce(_says(n, c), F.col(f"_{c}{k - 1}"))).alias(f"_{c}{k}") for c in _OWN]
        t = t.select(*(c for c in t.columns if c not in ("_n", "_children")), _mounts(n).alias(f"_mounts{k}"), *said, n["children"].alias("_children"))
        if k < _READ - 1:
            t = t.select("*", F.posexplode_outer("_children").alias(f"_i{k + 1}", "_n"))
    last = F.struct(F.array().cast("array<int>").alias("place"), *(F.col(f"_{c}{_READ - 1}").alias(c) for c in _OWN), F.col("_children").alias("children"))
    t = t.withColumn("_below", F.when(F.col("_children").isNotNull(), _all_below(last)))

    def level(k: int) -> Column:
        first = F.lit(True)
        for i in range(k + 1, _READ):
            first &= F.coalesce(F.col(f"_i{i}"), F.lit(0)) == 0
        return F.struct(F.array().cast("array<int>").alias("place"), F.when(first, F.col(f"_mounts{k}")).alias("mounts"), *(F.col(f"_{c}{k}").alias(c) for c in _OWN))

    nodes = F.concat(F.array(*map(level, range(_READ))), F.coalesce("_below", F.array().cast(f"array<struct<{_NODE}>>")))
    rows = t.select("doc", F.array(*(f"_i{k}" for k in range(_READ))).alias("_at"), F.posexplode(nodes).alias("_j", "_node"))
    rows = rows.select("doc", "_at", "_j", "_node.*", F.posexplode(F.array_distinct("_node.mounts")).alias("_k", "mount_point")).where("mount_point != ''").withColumn("rotational", rotational(F.col("rota")))
    known = sum((F.col(c).isNotNull().cast("int") for c in ("vendor", "model", "tran", "rotational")), F.lit(0))
    order = F.row_number().over(W.partitionBy("doc").orderBy("_at", "_j", "_k")) - 1
    return rows.select("doc", order.cast("int").alias("pos"), "mount_point", "vendor", "model", F.col("tran").alias("interface"), "rotational",
                       F.least(F.lit(0.70) + 0.05 * known, F.lit(0.9)).alias("confidence"), F.lit("lsblk").alias("source"))


def cim_rows(docs: DataFrame) -> DataFrame:
    """docs: doc, text of a captured CIM query: one object or an array of them, under the names of either of its forms.
    Rows of DOCUMENT_HINT; a record without a drive gives none."""
    nodes = docs.sparkSession.sql(_CIM, docs=docs.select("doc", "text"))
    field = lambda *names: F.coalesce(*(optional(F.try_variant_get("node", f"$.{n}", "string")) for n in names))
    drive = F.regexp_replace(field("mount_point", "DriveLetter"), r"[:\\]+$", "")
    rows = nodes.select("doc", "pos", F.concat(F.upper(drive), F.lit(":\\")).alias("mount_point"), field("vendor", "Manufacturer").alias("vendor"), field("model", "Model").alias("model"),
                        field("interface", "BusType", "InterfaceType").alias("interface"),
                        F.coalesce(rotational(field("rotational")), media_rotational(field("media_type", "MediaType"))).alias("rotational"))
    known = sum((F.col(c).isNotNull().cast("int") for c in ("interface", "rotational", "model")), F.lit(0))
    return rows.where(F.col("mount_point").isNotNull()).select("doc", F.col("pos").cast("int").alias("pos"), "mount_point", "vendor", "model", "interface", "rotational",
                                                              F.least(F.lit(0.72) + 0.06 * known, F.lit(0.9)).alias("confidence"), F.lit("cim").alias("source"))


#: By platform: the command whose output is hints, and how it is read.  CIM_QUERY prints mounts of all drives as JSON.
CIM_QUERY = "Get-CimInstance Win32_DiskDrive | ForEach-Object { $d = $_; Get-CimAssociatedInstance -InputObject $d -ResultClassName Win32_DiskPartition | ForEach-Object { " \
    "Get-CimAssociatedInstance -InputObject $_ -ResultClassName Win32_LogicalDisk | ForEach-Object { [pscustomobject]@{ mount_point = $_.DeviceID; model = $d.Model; " \
    "vendor = $d.Manufacturer; interface = $d.InterfaceType; media_type = $d.MediaType } } } } | ConvertTo-Json -Compress"
COMMANDS = {
    "Linux": (["lsblk", "-J", "-o", "NAME,MOUNTPOINT,MODEL,VENDOR,TRAN,ROTA"], lsblk_rows),
    "Windows": (["powershell", "-NoProfile", "-NonInteractive", "-Command", CIM_QUERY], cim_rows),
}


def platform_hints(spark: SparkSession, run=subprocess.run, system: str | None = None) -> DataFrame:
    """Hints of this machine; none where its command is missing or fails, or the platform has none."""
    command, read = COMMANDS.get(system or platform.system(), (None, None))
    if command:
        try:
            got = run(command, capture_output=True, text=True, timeout=20)
            if got.returncode == 0 and got.stdout.strip():
                return landed(read(local_table(spark, [("", got.stdout)], "doc string, text string")).drop("doc"))
        except (OSError, subprocess.SubprocessError):
            pass
    return local_table(spark, [], HINT)
