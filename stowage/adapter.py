"""The driver's tables seen as storage inventories: one deterministic mapping, in Spark and in DuckDB SQL.

documents are files (source: root and mount, lang: first-level directory, text: content), and sizes of disks follow from
them; a byte of text stands for a MiB on the paths and disks, so the rules' thresholds mean something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.scalars import extension, top_directory
from .operators import classify, disks, duplicates, usage
from .operators.mounts import match_mounts
from .tables import landed, local_table

AS_OF = "2026-02-11 00:00:00"
SCAN = "adapter"
EXTENSIONS = ("txt", "md", "jpg", "zip", "rs", "pdf", "mp4", "pak")
SUFFIXES = ("", "-photos", "-backup", "-projects", "-steam", "-archive")
NAMES = ("Samsung NVMe fast", "WD Blue photos", "Seagate Backup disk", "Work SSD projects", "user@gmail.com Google Drive", "Games library", "Old archive disk", "USB stick")
KINDS = ("ssd", "hdd", "hdd", "ssd", "unknown", "ssd", "hdd", "unknown")
MIB = 1 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _number(source):
    return F.coalesce(F.regexp_extract(source, "[0-9]+", 0).try_cast("int"), F.lit(0))


def files(spark, sf_dir: str, content: bool = False) -> DataFrame:
    """With content, texts are hashed; without, the scan does not hash (nor need) them beyond their size."""
    d = table(spark, sf_dir, "documents")
    root = F.concat(F.lit("/"), F.col("source"), _pick(SUFFIXES, _number(F.col("source")) % 6))
    modified = F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(
        F.to_timestamp(F.lit(AS_OF)) - F.make_interval(days=(F.col("doc_id") % 1200).cast("int")))
    out = d.select("doc_id", root.alias("root_path"), root.alias("disk_mount"), "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size_bytes"),
                   modified.alias("modified_ts"), *([F.sha2("text", 256).alias("content_hash")] if content else []))
    path = F.concat("root_path", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), _pick(EXTENSIONS, F.col("doc_id") % 8))
    out = out.withColumns({"path": path, "scan_id": F.lit(SCAN)})
    return out.withColumns({"extension": extension(F.col("path")), "top_dir": top_directory(F.col("path"), F.col("root_path"))}).drop("lang")


def paths(spark, sf_dir: str) -> DataFrame:
    t = usage.totals(files(spark, sf_dir), F.to_timestamp(F.lit(AS_OF)))
    big = (F.col("total_size_bytes") * MIB).alias("total_size_bytes")
    return t.select("scan_id", "root_path", "disk_mount", "file_count", big, F.col("total_size_bytes").alias("type_total_bytes"), "recent_files", "stale_files", "unknown_modified_files",
                    (_number(F.col("root_path"))).alias("pos"))


def probes(spark, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """of: the paths, where they are at hand."""
    k = F.col("pos")
    p = (paths(spark, sf_dir) if of is None else of).select("scan_id", "pos", F.col("root_path").alias("mount_point"), F.col("total_size_bytes").alias("s"))
    p = p.withColumn("used", F.col("s") * (1 + k % 3))
    total = F.when(k % 4 == 3, F.col("used") + F.floor(F.col("used") / 12)).otherwise(4 * F.col("s"))
    return p.select("scan_id", "pos", "mount_point", _pick(NAMES, k % 8).alias("name"), total.alias("total_space_bytes"), (total - F.col("used")).alias("free_space_bytes"),
                    _pick(KINDS, k % 8).alias("disk_kind"), F.when(k % 8 == 4, "fuse.drivefs").when(k == 10, "nfs4").otherwise("ext4").alias("file_system"), (k % 8 == 7).alias("is_removable"))


def enriched(spark, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    return disks.enrich(probes(spark, sf_dir, of), os_mount="/src3-projects")


def tables(spark, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The tables named (else all) of the one scan that a folder is, read from the folder anew at each call.  What has a row
    a root or disk is worked out once, since every rule reads it."""
    made: dict[str, DataFrame] = {}
    f = files(spark, sf_dir)

    def get(name: str) -> DataFrame:
        if name not in made:
            made[name] = how[name]()
        return made[name]

    def groups() -> DataFrame:
        g = duplicates.groups(files(spark, sf_dir, content=True)).withColumn("pos", F.lit(0))
        return g.withColumn("total_wasted_bytes", F.col("total_wasted_bytes") * MIB)

    how = {
        "scans": lambda: local_table(spark, [(SCAN,)], "scan_id string"),
        "files": lambda: f,
        "paths": lambda: landed(paths(spark, sf_dir)),
        "extensions": lambda: landed(usage.top_extensions(f)),
        "path_extensions": lambda: get("extensions"),
        "path_directories": lambda: landed(usage.top_directories(f).join(get("paths").select("root_path", F.col("pos").alias("path_pos")), "root_path")),
        "enriched": lambda: landed(enriched(spark, sf_dir, get("paths"))),
        "categories": lambda: landed(classify.all_categories(get("paths"), get("path_directories"), get("extensions"), get("enriched"))),
        "disks": lambda: landed(classify.infer_roles(get("enriched"), get("categories"))),
        "duplicate_groups": groups,
    }
    return {n: get(n) for n in names or ("scans", "files", "paths", "path_directories", "path_extensions", "disks", "categories", "duplicate_groups")}


def url_paths(spark, sf_dir: str) -> DataFrame:
    """pages as a tree: scheme left out, query and fragment cut off."""
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", "://([^?#]*)", 1)).alias("path"))


def url_mounts(spark, sf_dir: str) -> DataFrame:
    """Mounts of that tree: hosts, and the French and German parts of hosts."""
    p = url_paths(spark, sf_dir)
    host = p.select(F.regexp_extract("path", "^/[^/]*", 0).alias("mount_point"))
    part = p.select(F.regexp_extract("path", "^/[^/]*/(?:fr|de)(?=/)", 0).alias("mount_point")).where("mount_point <> ''")
    return host.unionByName(part).distinct().withColumn("pos", F.lit(0))


def snapshots(spark, sf_dir: str) -> DataFrame:
    """A snapshot for each ten days of events: a root and disk for each event type, which grows by its values; disks of
    types with long names are large."""
    pos = F.floor(F.datediff("day", F.to_date(F.lit("2024-01-01"))) / 10).cast("int")
    day = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value").groupBy(pos.alias("snap_pos"), F.concat(F.lit("/"), "event_type").alias("mount_point")).agg(
        (F.round(F.sum("value")) * 2**24).cast("bigint").alias("more"))
    grown = F.sum("more").over(W.partitionBy("mount_point").orderBy("snap_pos"))
    when = F.date_add(F.to_date(F.lit("2024-01-01")), F.col("snap_pos") * 10 + 9)
    total = F.expr("shiftleft(1L, 35 + length(mount_point))")
    out = day.select("snap_pos", F.concat(when.cast("string"), F.lit("T00:00:00Z")).alias("generated_at"), "mount_point", F.col("mount_point").alias("root_path"), total.alias("total_space_bytes"), grown.alias("total_size_bytes"))
    return out.withColumn("free_space_bytes", F.col("total_space_bytes") - F.col("total_size_bytes"))


def order_slices(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two reports of roots and disks: customers' orders before and since the middle of the years."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("/c"), F.col("o_custkey").cast("string")).alias("root_path"), F.col("o_totalprice"), (F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp")).alias("late"),
                                              "o_orderpriority")
    agg = o.groupBy("late", "root_path").agg(F.round(F.sum("o_totalprice")).cast("bigint").alias("total_size_bytes"), F.count(F.lit(1)).alias("file_count"))
    both = agg.withColumns({"mount_point": F.col("root_path"), "name": F.concat(F.lit("disk "), F.col("root_path")), "free_space_bytes": F.col("total_size_bytes")})
    return both.where("not late"), both.where("late")


def recommendations(spark, sf_dir: str) -> DataFrame:
    """orders as recommendations of a scan a month: target a mount of the adapter, risk by priority, saving by price."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("scan_id"), k.alias("pos"), F.when(k % 9 == 0, "active-workload-placement").otherwise(F.concat(F.lit("rec-"), (F.col("o_custkey") % 50).cast("string"))).alias("id"),
                    F.concat(F.lit("title "), "o_orderpriority").alias("title"), F.concat(F.lit("status "), "o_orderstatus").alias("rationale"), (F.lit(0.5) + (k % 5) / 10).alias("confidence"),
                    F.when(k % 3 == 0, F.concat(F.lit("/src"), (k % 24).cast("string"), _pick(SUFFIXES, (k % 24) % 6))).alias("target_mount"), (k % 7 != 0).alias("policy_safe"),
                    F.when(F.substring("o_orderpriority", 1, 1).cast("int") <= 2, "high").when(F.substring("o_orderpriority", 1, 1) == "3", "medium").otherwise("low").alias("risk_level"),
                    F.when(k % 4 != 0, F.round("o_totalprice").cast("bigint")).alias("space_saving_bytes"), F.array().cast("array<string>").alias("policy_rules_applied"),
                    F.array(F.struct(F.when(k % 2 == 0, "disk").otherwise("warning").alias("kind"))).alias("evidence"))


def mounts_for(paths_df: DataFrame, mounts: DataFrame) -> DataFrame:
    return match_mounts(paths_df, mounts, "path")


# --- the same in DuckDB SQL

def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NUM = "coalesce(try_cast(regexp_extract({0}, '[0-9]+') AS INT), 0)"
FILES = f"""files AS (
  SELECT doc_id, root_path, root_path AS disk_mount, root_path || '/' || lang || '/' || doc_id || '.' || ext AS path, root_path || '/' || lang AS top_dir, ext AS extension,
         coalesce(strlen(text), 0)::BIGINT AS size_bytes, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE TIMESTAMP '{AS_OF}' - to_days((doc_id % 1200)::INT) END AS modified_ts, sha256(text) AS hash
  FROM (SELECT *, '/' || source || ({_list(SUFFIXES)})[{_NUM.format('source')} % 6 + 1] AS root_path, ({_list(EXTENSIONS)})[(doc_id % 8 + 1)::INT] AS ext FROM documents))"""
PATHS = FILES + f""", paths AS (
  SELECT root_path, root_path AS disk_mount, count(*)::BIGINT AS file_count, sum(size_bytes)::BIGINT * {MIB} AS total_size_bytes, sum(size_bytes)::BIGINT AS type_total_bytes,
         (count(*) FILTER (WHERE modified_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS))::BIGINT AS recent_files,
         (count(*) FILTER (WHERE modified_ts <= TIMESTAMP '{AS_OF}' - INTERVAL 730 DAYS))::BIGINT AS stale_files,
         (count(*) FILTER (WHERE modified_ts IS NULL))::BIGINT AS unknown_modified_files, {_NUM.format('root_path')} AS pos
  FROM files GROUP BY root_path)"""
PROBES = PATHS + f""", probes AS (
  SELECT pos, mount_point, ({_list(NAMES)})[pos % 8 + 1] AS name, total AS total_space_bytes, total - used AS free_space_bytes, ({_list(KINDS)})[pos % 8 + 1] AS disk_kind,
         CASE WHEN pos % 8 = 4 THEN 'fuse.drivefs' WHEN pos = 10 THEN 'nfs4' ELSE 'ext4' END AS file_system, pos % 8 = 7 AS is_removable, used AS used_bytes
  FROM (SELECT *, CASE WHEN pos % 4 = 3 THEN used + used // 12 ELSE 4 * s END AS total FROM (SELECT pos, root_path AS mount_point, total_size_bytes AS s, total_size_bytes * (1 + pos % 3) AS used FROM paths)))"""


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def case(column: str, mapping: dict, other: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {other} END"


def _vendor() -> str:
    return "CASE " + " ".join(f"WHEN contains(n, '{w}') THEN '{v}'" for w, v in disks.VENDORS) + " END"


ENRICHED = PROBES + f""", e1 AS (SELECT *, lower(name) AS n, lower(mount_point) AS m, lower(file_system) AS f FROM probes),
e2 AS (
  SELECT *, CASE WHEN (contains(n, '@') AND (contains(n, 'googl') OR contains(n, 'drive'))) OR {any_of('n', disks.CLOUD_WORDS)} OR {any_of('m', disks.CLOUD_WORDS)} OR {any_of('f', disks.CLOUD_WORDS)} THEN 'cloud_backed'
              WHEN starts_with(m, '//') OR {any_of('f', disks.NETWORK_FS)} THEN 'network'
              WHEN {any_of('n', disks.VIRTUAL_NAMES)} OR {any_of('f', disks.VIRTUAL_FS)} THEN 'local_virtual' WHEN m <> '' THEN 'local_physical' ELSE 'unknown' END AS locality_class,
         CASE WHEN contains(n, 'nvme') OR contains(f, 'nvme') THEN 'nvme' WHEN is_removable OR contains(n, 'usb') THEN 'usb'
              WHEN starts_with(m, '//') OR {any_of('f', disks.NETWORK_FS)} THEN 'network' END AS interface, {_vendor()} AS vendor,
         mount_point = '/src3-projects' AS is_os_drive
  FROM e1),
e3 AS (
  SELECT *, CASE locality_class WHEN 'cloud_backed' THEN 'cloud_backed' WHEN 'network' THEN 'network' WHEN 'local_virtual' THEN 'virtual'
              ELSE CASE WHEN contains(n, 'nvme') OR coalesce(interface, '') = 'nvme' THEN 'nvme' WHEN is_removable OR coalesce(interface, '') = 'usb' OR contains(n, 'usb') THEN 'usb'
                        WHEN disk_kind IN ('ssd', 'hdd') THEN disk_kind ELSE 'unknown' END END AS storage_type
  FROM e2),
enriched AS (
  SELECT *, CASE WHEN storage_type = 'unknown' AND locality_class = 'local_physical' THEN 'balanced' ELSE {case('storage_type', {k: v[0] for k, v in disks.PERFORMANCE.items()}, "'unknown'")} END AS performance_class,
         CASE WHEN storage_type = 'unknown' AND locality_class = 'local_physical' THEN 0.4 ELSE {case('storage_type', {k: v[1] for k, v in disks.PERFORMANCE.items()}, '0.35')} END::DOUBLE AS performance_confidence,
         NOT is_os_drive AND locality_class = 'local_physical' AND storage_type NOT IN ('cloud_backed', 'network', 'virtual') AS eligible_for_local_target
  FROM e3),
ranked AS (
  SELECT *, round({case('performance_class', disks.RANK, '0.5')} + {case('storage_type', disks.BONUS, '-0.2')} + 0.2 * performance_confidence, 6)::DOUBLE AS performance_rank FROM enriched)"""
EXTS = """, exts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_path ORDER BY bytes DESC, extension) AS k
                 FROM (SELECT root_path, extension, count(*)::BIGINT AS files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY ALL)) WHERE k <= 12)
, dirs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_path ORDER BY size_bytes DESC, path) AS k
                 FROM (SELECT root_path, top_dir AS path, sum(size_bytes)::BIGINT AS size_bytes FROM files GROUP BY ALL)) WHERE k <= 10)"""


def _signals() -> str:
    parts = []
    for c, w, words, more in classify.PATH_NAMES:
        parts.append(f"SELECT root_path AS target, disk_mount, '{c}' AS category, {w}::DOUBLE AS delta, 'name:{c}' AS evidence FROM paths p WHERE {any_of('lower(root_path)', words)} "
                     f"OR EXISTS (SELECT 1 FROM dirs d WHERE d.root_path = p.root_path AND {any_of('lower(d.path)', more)})")
    for c, w, least, exts in classify.EXTENSION_RULES:
        parts.append(f"SELECT e.root_path, p.disk_mount, '{c}', {w} * (bytes / greatest(type_total_bytes, 1)), 'extension:{c}' FROM exts e JOIN paths p ON p.root_path = e.root_path "
                     f"WHERE extension IN ({', '.join(repr(x) for x in exts)}) AND bytes / greatest(type_total_bytes, 1) >= {least}")
    n = "greatest(file_count, 1)"
    parts.append(f"SELECT root_path, disk_mount, 'archive', 0.4, 'activity:stale' FROM paths WHERE stale_files / {n} > 0.6")
    parts.append(f"SELECT root_path, disk_mount, 'work', 0.3, 'activity:recent' FROM paths WHERE recent_files / {n} > 0.35")
    parts.append(f"SELECT root_path, disk_mount, 'backup', 0.2, 'activity:dormant' FROM paths WHERE stale_files / {n} > 0.7 AND recent_files / {n} < 0.1")
    return " UNION ALL ".join(parts)


def _disk_signals() -> str:
    return " UNION ALL ".join(
        f"SELECT mount_point AS target, mount_point AS disk_mount, '{c}' AS category, {w}::DOUBLE AS delta, 'label:{c}' AS evidence FROM enriched WHERE {any_of(LABEL, words)}" for c, w, words in classify.DISK_NAMES)


LABEL = "lower(name || ' ' || name)"
_SCORE = "SELECT target, disk_mount, category, least(sum(delta), 1.0)::DOUBLE AS confidence, list_sort(list_distinct(list(evidence))) AS evidence FROM {0} GROUP BY target, disk_mount, category HAVING round(sum(delta), 6) >= 0.35"
CATEGORIES = ENRICHED + EXTS + f""", psig AS ({_signals()}), dsig AS ({_disk_signals()}),
both_ AS ({_SCORE.format('psig')} UNION ALL {_SCORE.format('dsig')}),
agg_ AS (SELECT disk_mount AS target, disk_mount, category, least(avg(confidence), 1.0)::DOUBLE AS confidence, list_sort(list_distinct(flatten(list(evidence)))) AS evidence, count(*)::BIGINT AS suggestions
         FROM both_ GROUP BY disk_mount, category HAVING round(least(avg(confidence), 1.0), 6) >= 0.35),
cats AS (SELECT * FROM both_ UNION ALL SELECT target, disk_mount, category, confidence, evidence FROM agg_)"""
SCORES = CATEGORIES + ", scores AS (SELECT disk_mount AS mount_point, " + ", ".join(
    f"coalesce(sum(confidence) FILTER (WHERE category = '{c}'), 0)::DOUBLE AS {c}" for c in ("games", "work", "media", "archive", "backup")) + """ FROM cats GROUP BY disk_mount),
sd AS (SELECT r.*, """ + ", ".join(f"round(coalesce(s.{c}, 0), 6) AS {c}" for c in ("games", "work", "media", "archive", "backup")) + """ FROM ranked r LEFT JOIN scores s ON s.mount_point = r.mount_point)"""


def _bonus(c: str) -> str:
    return " + ".join([f"coalesce(s.{c}, 0)", *(f"CASE WHEN {any_of(LABEL, words)} THEN {w} ELSE 0 END" for k, w, words, _ in classify.ROLE_LABELS if k == c)])


ROLES = SCORES + ", rs AS (SELECT r.*, " + ", ".join(f"round({_bonus(c)}, 6)::DOUBLE AS {c}" for c in ("games", "work", "media", "archive", "backup")) + """ FROM ranked r LEFT JOIN scores s ON s.mount_point = r.mount_point),
roles AS (
  SELECT *, CASE WHEN backup >= 0.85 AND backup > games + work + 0.2 THEN 'backup_target' WHEN media >= 0.8 AND media > games + work + 0.2 THEN 'media_library'
                 WHEN games >= 0.85 AND games >= work THEN 'games_library' WHEN games + work >= 0.9 AND games + work > media + archive + backup + 0.2 THEN 'active_workload'
                 WHEN archive >= 0.75 AND archive > games + work THEN 'archive'
                 WHEN (games >= 0.5)::INT + (work >= 0.5)::INT + (media >= 0.5)::INT + (archive >= 0.5)::INT + (backup >= 0.5)::INT >= 2 THEN 'mixed' ELSE 'unknown' END AS role,
         least(greatest(games, work, media, archive, backup), 1.0)::DOUBLE AS role_confidence
  FROM rs)"""
DUPS = FILES + """, dups AS (
  SELECT size_bytes, hash, count(*)::BIGINT AS file_count, size_bytes * (count(*) - 1) AS total_wasted_bytes, count(DISTINCT disk_mount)::BIGINT AS mounts, list_sort(list(path)) AS paths,
         CASE WHEN bool_or(""" + any_of("lower(path)", duplicates.KEPT_ON_PURPOSE) + """) OR (count(DISTINCT disk_mount) > 1 AND count(DISTINCT regexp_extract(lower(path), '[^/]+/[^/]+$')) = 1)
              THEN 'likely_intentional' ELSE 'likely_redundant' END AS intent
  FROM files GROUP BY size_bytes, hash HAVING count(*) > 1)"""
SNAPS = """snaps AS (
  SELECT snap_pos, DATE '2024-01-01' + (snap_pos * 10 + 9) AS day, mount_point, (1::BIGINT << (35 + length(mount_point))) AS total, (sum(more) OVER (PARTITION BY mount_point ORDER BY snap_pos))::BIGINT AS grown
  FROM (SELECT (date_diff('day', DATE '2024-01-01', ts::DATE) // 10)::INT AS snap_pos, '/' || event_type AS mount_point, (round(sum(value)) * 16777216)::BIGINT AS more FROM events GROUP BY ALL))"""
SLICES = """slices AS (
  SELECT o_orderdate >= TIMESTAMP '1998-07-01' AS late, '/c' || o_custkey AS root_path, round(sum(o_totalprice))::BIGINT AS size, count(*)::BIGINT AS n FROM orders GROUP BY ALL),
l AS (SELECT * FROM slices WHERE NOT late), r AS (SELECT * FROM slices WHERE late)"""
RECS = f"""recs AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS scan_id, o_orderkey AS pos, CASE WHEN o_orderkey % 9 = 0 THEN 'active-workload-placement' ELSE 'rec-' || (o_custkey % 50) END AS id,
         'title ' || o_orderpriority AS title, 'status ' || o_orderstatus AS rationale, 0.5 + (o_orderkey % 5) / 10 AS confidence,
         CASE WHEN o_orderkey % 3 = 0 THEN '/src' || (o_orderkey % 24) || ({_list(SUFFIXES)})[((o_orderkey % 24) % 6 + 1)::INT] END AS target_mount, o_orderkey % 7 <> 0 AS policy_safe,
         CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS risk_level,
         CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice)::BIGINT END AS space_saving_bytes, CASE WHEN o_orderkey % 2 = 0 THEN 'disk' ELSE 'warning' END AS kind
  FROM orders)"""
