"""queries() and oracle_sql() of the reference operators, over the adapter's tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapter as a
from . import lines, schemas
from .functions import blake3
from .functions import scalars as s
from .operators import classify, duplicates, filters, mounts, usage
from .plans import diff, evaluate, policy, rules, scenario, trend
from .sinks import ReportTable
from .streaming import events as ev
from .streaming import states
from .tables import Commits, landed, scratch

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def as_of():
    return F.to_timestamp(F.lit(a.AS_OF))


def r6(c: str):
    return F.round(c, 6).alias(c)


# --- usage


@query(f"WITH {a.PATHS} SELECT root_path, disk_mount, file_count, type_total_bytes AS total_size_bytes, recent_files, stale_files, unknown_modified_files FROM paths")
def usage_by_root(spark, d) -> DataFrame:
    return usage.totals(a.files(spark, d), as_of()).drop("scan_id")


@query(f"WITH {a.PATHS} SELECT count(*)::BIGINT AS scanned_roots, sum(file_count)::BIGINT AS scanned_files, sum(type_total_bytes)::BIGINT AS scanned_bytes FROM paths")
def scan_counters(spark, d) -> DataFrame:
    return usage.scan_counters(usage.totals(a.files(spark, d), as_of())).drop("scan_id")


@query(f"WITH {a.FILES} SELECT root_path, extension, count(*)::BIGINT AS files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY ALL")
def ext_histogram(spark, d) -> DataFrame:
    return usage.extensions(a.files(spark, d)).drop("scan_id")


@query(f"""WITH {a.FILES}, e AS (SELECT root_path, extension, count(*) AS files, sum(size_bytes) AS bytes FROM files GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY root_path ORDER BY bytes DESC, extension) AS k FROM e)
SELECT root_path, string_agg(extension, ',' ORDER BY k) FILTER (WHERE k <= 3) AS top_extensions, coalesce(sum(files) FILTER (WHERE k > 3), 0)::BIGINT AS other_files,
       coalesce(sum(bytes) FILTER (WHERE k > 3), 0)::BIGINT AS other_bytes, sum(files)::BIGINT AS total_files, sum(bytes)::BIGINT AS total_bytes FROM k GROUP BY root_path""")
def top_ext_with_other(spark, d) -> DataFrame:
    out = usage.extension_summary(a.files(spark, d), 3)
    return out.withColumn("top_extensions", F.array_join("top_extensions.extension", ",")).drop("scan_id")


@query(f"WITH {a.FILES}{a.EXTS} SELECT root_path, path, size_bytes, (k - 1)::INT AS pos FROM dirs")
def top_dirs(spark, d) -> DataFrame:
    return usage.top_directories(a.files(spark, d)).drop("scan_id")


@query(f"""WITH {a.FILES} SELECT root_path, path, size_bytes, (k - 1)::INT AS pos FROM (
SELECT *, row_number() OVER (PARTITION BY root_path ORDER BY size_bytes DESC, path) AS k FROM files) WHERE k <= 20""")
def largest_files_per_root(spark, d) -> DataFrame:
    return usage.largest_files(a.files(spark, d)).drop("scan_id", "modified_ts")


@query("""SELECT activity, count(*)::BIGINT AS orders FROM (SELECT CASE WHEN o_orderdate IS NULL THEN 'unknown' WHEN o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAYS THEN 'recent'
WHEN o_orderdate <= TIMESTAMP '2001-08-01' - INTERVAL 730 DAYS THEN 'stale' ELSE 'other' END AS activity FROM orders) GROUP BY activity""")
def activity_signals(spark, d) -> DataFrame:
    kind = usage.activity(F.col("o_orderdate"), F.to_timestamp(F.lit("2001-08-01 00:00:00")))
    return a.table(spark, d, "orders").groupBy(kind.alias("activity")).agg(F.count(F.lit(1)).alias("orders"))


@query(f"""WITH {a.FILES} SELECT path, size_bytes FROM files WHERE NOT (regexp_matches(path, '^.*/[^/]*[13579]\\.zip$') OR contains(lower(path), '/de/') OR regexp_matches(root_path || '/' || split_part(path, '/', 3), '^/src1.*/(es|pt)$'))""")
def exclude_glob(spark, d) -> DataFrame:
    x = filters.Excludes(["**/*[13579].zip", "/DE/", "/src1*/{es,pt}", "  "])
    return x.prune(a.files(spark, d)).select("path", "size_bytes")


@query(f"""WITH {a.FILES} SELECT path, sum(size_bytes)::BIGINT AS size_bytes, count(*)::BIGINT AS files FROM (
SELECT root_path AS path, size_bytes FROM files UNION ALL SELECT top_dir, size_bytes FROM files) GROUP BY path""")
def tree_rollup(spark, d) -> DataFrame:
    return usage.tree_rollup(a.files(spark, d)).drop("scan_id", "root_path")


@query(f"""WITH {a.FILES}, n AS (SELECT count(*) AS f, sum(size_bytes) AS b FROM files),
o AS (SELECT sum(f) AS f, sum(b) AS b FROM (SELECT top_dir, count(*) AS f, sum(size_bytes) AS b FROM files WHERE NOT contains(path, '/de/') GROUP BY top_dir))
SELECT (o.f - n.f)::BIGINT AS scanned_files_delta, (o.b - n.b)::BIGINT AS scanned_bytes_delta, abs(o.b - n.b) / greatest(n.b, 1) <= 0.05 AS within_tolerance FROM n, o""")
def parity_check(spark, d) -> DataFrame:
    """The direct sums of all files, and the tree rollup of those outside the German directories, which differ."""
    f = a.files(spark, d)
    sums = lambda df, n: df.groupBy("scan_id").agg(F.sum(n).cast("bigint").alias("scanned_files"), F.sum("size_bytes").alias("scanned_bytes"), F.lit(0).alias("elapsed_ms"))
    rolled = usage.tree_rollup(f.where(~F.col("path").contains("/de/"))).where(F.col("path") == F.col("root_path"))
    return usage.parity(sums(f.withColumn("files", F.lit(1)), "files"), sums(rolled, "files")).select("scanned_files_delta", "scanned_bytes_delta", "within_tolerance")


@query(f"""WITH {a.FILES}{a.EXTS} SELECT root_path, path, size_bytes, (k - 1)::INT AS pos FROM dirs""")
def backend_directories(spark, d) -> DataFrame:
    """The second backend's directories: ranked from the rollup of the whole tree."""
    rolled = usage.tree_rollup(a.files(spark, d))
    first = F.col("path") == s.top_directory(F.concat("path", F.lit("/.")), F.col("root_path"))
    return usage.top(rolled.where(first).select("scan_id", "root_path", "path", "size_bytes"), usage.TOP_DIRECTORIES, F.desc("size_bytes"), "path").drop("scan_id")


@query("""SELECT event_type AS backend, count(*)::BIGINT AS iterations, round(avg(value), 6) AS avg_elapsed_ms, round(avg(user_id * 1000), 6) AS avg_bytes,
round(CASE WHEN avg(value) > 0 THEN avg(user_id * 1000) / 1048576 / (avg(value) / 1000) ELSE 0 END, 6) AS avg_throughput_mb_s FROM events GROUP BY event_type""")
def benchmark_throughput(spark, d) -> DataFrame:
    e = a.table(spark, d, "events").select(F.col("event_type").alias("backend"), F.col("value").alias("elapsed_ms"), F.lit(1).alias("files"), (F.col("user_id") * 1000).alias("bytes"))
    return usage.benchmark(e).select("backend", "iterations", r6("avg_elapsed_ms"), r6("avg_bytes"), r6("avg_throughput_mb_s"))


@query(f"""WITH {a.FILES} SELECT root_path, count(*)::BIGINT AS file_count, sum(size_bytes)::BIGINT AS total_size_bytes FROM files WHERE NOT contains(root_path, '7') GROUP BY root_path""")
def committed_usage(spark, d) -> DataFrame:
    """Usage over a tree that was committed in part: what a job that was lost had written of some roots is not seen."""
    lost = F.contains("root_path", F.lit("7"))
    f = a.files(spark, d).select("scan_id", "root_path", "path", "size_bytes", "disk_mount", "modified_ts")
    t = Commits(spark, scratch(spark, "committed"), f.schema)
    even = F.pmod(F.xxhash64("root_path"), F.lit(2)) == 0
    t.append(f.where(~lost & even), "first")
    t.append(f.where(~lost & ~even), "second")
    f.where(lost).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{t.folder}/third")  # as a lost job leaves it
    return usage.totals(t.read(), as_of()).select("root_path", "file_count", "total_size_bytes")


# --- duplicates


@query(f"WITH {a.DUPS} SELECT size_bytes, hash, file_count, total_wasted_bytes FROM dups")
def dup_groups(spark, d) -> DataFrame:
    return duplicates.ranked(duplicates.groups(a.files(spark, d, content=True)).select("size_bytes", "hash", "file_count", "total_wasted_bytes"))


@query(f"WITH {a.FILES} SELECT path, size_bytes FROM (SELECT *, count(*) OVER (PARTITION BY size_bytes) AS n FROM files WHERE size_bytes >= 100) WHERE n > 1")
def dup_two_phase(spark, d) -> DataFrame:
    return duplicates.candidates(a.files(spark, d), 100).select("path", "size_bytes")


@query(f"""WITH {a.DUPS} SELECT hash, intent, mounts, unnest(paths) AS path, unnest(range(1, len(paths) + 1)) AS number FROM dups""")
def dup_intent(spark, d) -> DataFrame:
    """Each file of each group, numbered by path, beside what its group looks like."""
    f = a.files(spark, d, content=True)
    g = duplicates.groups(f)
    children = duplicates.numbered(duplicates.group_files(f, g))
    return children.join(g.select(*duplicates.KEY, "intent", "mounts"), list(duplicates.KEY)).select("hash", "intent", "mounts", "path", "number")


@query("SELECT min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def content_groups(spark, d) -> DataFrame:
    """Texts by their content digest, as the scan hashes files."""
    t = blake3.with_digest(a.table(spark, d, "documents").select("doc_id", "text"), "text")
    return t.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).drop("digest")


@query(f"""WITH {a.DUPS} SELECT hash, file_count, greatest(file_count - 2, 0) AS more_files, array_to_string(paths[1:2], ',') AS first_paths FROM dups""")
def dup_first_files(spark, d) -> DataFrame:
    """What a report of two files a group holds."""
    g = duplicates.duplicate_groups(a.files(spark, d, content=True), most=2)
    return g.select("hash", "file_count", "more_files", F.array_join("files.path", ",").alias("first_paths"))


@query(f"""WITH {a.DUPS} SELECT coalesce(sum(total_wasted_bytes), 0)::BIGINT AS wasted_bytes, count(*)::BIGINT AS groups,
coalesce(sum(total_wasted_bytes) FILTER (WHERE intent = 'likely_redundant' AND total_wasted_bytes >= 1000), 0)::BIGINT AS redundant_bytes FROM dups""")
def dup_waste_total(spark, d) -> DataFrame:
    g = duplicates.groups(a.files(spark, d, content=True))
    total = duplicates.total_waste(g).join(duplicates.redundant_waste(g, 1000, 1).select("scan_id", F.col("wasted_bytes").alias("redundant_bytes")), "scan_id", "left")
    return total.select("wasted_bytes", "groups", F.coalesce("redundant_bytes", F.lit(0)).alias("redundant_bytes"))


@query(f"WITH {a.DUPS} SELECT hash, file_count FROM dups WHERE contains(intent, 'photos') OR contains(hash, 'photos') OR len(list_filter(paths, lambda p: contains(lower(p), 'photos'))) > 0")
def ui_search_dups(spark, d) -> DataFrame:
    f = a.files(spark, d, content=True)
    g = duplicates.groups(f)
    return filters.search_duplicates(g, " Photos ", duplicates.group_files(f, g)).select("hash", "file_count")


# --- mounts and roots


@query("""WITH p AS (SELECT page_id, '/' || regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages),
m AS (SELECT DISTINCT regexp_extract(path, '^/[^/]*') AS mount FROM p UNION SELECT DISTINCT regexp_extract(path, '^(/[^/]*/(fr|de))/', 1) FROM p WHERE regexp_matches(path, '^/[^/]*/(fr|de)/'))
SELECT p.page_id, p.path, arg_max(m.mount, length(m.mount)) AS disk_mount FROM p LEFT JOIN m ON p.path = m.mount OR starts_with(p.path, m.mount || '/') GROUP BY ALL""")
def mount_prefix_match(spark, d) -> DataFrame:
    return mounts.match_mounts(a.url_paths(spark, d), a.url_mounts(spark, d), "path")


@query("""SELECT pos, path FROM (SELECT doc_id AS pos, path, row_number() OVER (PARTITION BY lower(path) ORDER BY doc_id) AS k
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '/' || lang AS path FROM documents)) WHERE k = 1""")
def roots_dedupe(spark, d) -> DataFrame:
    p = F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("/"), "lang")
    return mounts.resolve_roots(a.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), p.alias("path")))


@query("""SELECT conv_id, count(*) FILTER (WHERE contains(lower(text), 'er'))::BIGINT AS permission_denied_warnings, count(*)::BIGINT AS warnings FROM conversations GROUP BY conv_id""")
def warnings_permission(spark, d) -> DataFrame:
    w = a.table(spark, d, "conversations").select(F.col("conv_id").alias("scan_id"), F.regexp_replace(F.lower("text"), "er", "permission").alias("text"))
    return filters.permission_warnings(w).withColumnRenamed("scan_id", "conv_id")


# --- disks, categories, roles


@query(f"""WITH {a.ENRICHED} SELECT mount_point, locality_class, storage_type, interface, vendor, performance_class, performance_confidence, is_os_drive FROM enriched""")
def disk_enrich(spark, d) -> DataFrame:
    return a.enriched(spark, d).select("mount_point", "locality_class", "storage_type", "interface", "vendor", "performance_class", "performance_confidence", "is_os_drive")


@query(f"""WITH {a.ENRICHED} SELECT mount_point, eligible_for_local_target, (is_os_drive::INT + (locality_class <> 'local_physical')::INT + (storage_type IN ('cloud_backed', 'network', 'virtual'))::INT)::INT AS reasons FROM enriched""")
def target_eligibility(spark, d) -> DataFrame:
    return a.enriched(spark, d).select("mount_point", "eligible_for_local_target", F.size("ineligible_reasons").alias("reasons"))


@query(f"WITH {a.ENRICHED} SELECT mount_point, performance_rank FROM ranked WHERE eligible_for_local_target AND NOT is_os_drive ORDER BY performance_rank DESC, pos DESC LIMIT 1")
def fastest_disk(spark, d) -> DataFrame:
    return rules.fastest(a.enriched(spark, d)).select("mount_point", r6("performance_rank"))


@query(f"WITH {a.CATEGORIES} SELECT target, category, round(confidence, 6) AS confidence, array_to_string(evidence, ',') AS evidence FROM ({a._SCORE.format('psig')})")
def category_signals(spark, d) -> DataFrame:
    f = a.files(spark, d)
    c = classify.categorize_paths(a.paths(spark, d), usage.top_directories(f), usage.top_extensions(f))
    return c.select("target", "category", r6("confidence"), F.array_join("evidence", ",").alias("evidence"))


@query(f"WITH {a.CATEGORIES} SELECT disk_mount, category, round(confidence, 6) AS confidence, suggestions FROM agg_")
def category_by_disk(spark, d) -> DataFrame:
    f = a.files(spark, d)
    own = classify.categorize_paths(a.paths(spark, d), usage.top_directories(f), usage.top_extensions(f))
    out = classify.aggregate_by_disk(own.unionByName(classify.categorize_disks(a.enriched(spark, d))))
    return out.select("disk_mount", "category", r6("confidence"), "suggestions")


@query(f"WITH {a.SCORES} SELECT mount_point AS disk_mount, round(games, 6) AS games, round(work, 6) AS work, round(media, 6) AS media, round(archive, 6) AS archive, round(backup, 6) AS backup FROM scores")
def category_scores_pivot(spark, d) -> DataFrame:
    return classify.score_pivot(a.tables(spark, d, "categories")["categories"]).select("disk_mount", *(r6(c) for c in classify.CATEGORIES))


@query(f"WITH {a.ROLES} SELECT mount_point, role, role_confidence FROM roles")
def disk_roles(spark, d) -> DataFrame:
    return a.tables(spark, d, "disks")["disks"].select("mount_point", "role", "role_confidence")


# --- rules


def _rule(rule, t) -> DataFrame:
    return rule(t).select("id", r6("confidence"), "target_mount", "space_saving_bytes", "risk_level")


_OUT = "target_mount, space_saving_bytes, risk_level"
_NONE = "NULL::VARCHAR AS target_mount, NULL::BIGINT AS space_saving_bytes"
_FREE = "free_space_bytes / total_space_bytes"


@query(f"""WITH {a.SCORES}, best AS (SELECT mount_point AS target, performance_rank AS top FROM ranked WHERE eligible_for_local_target AND NOT is_os_drive ORDER BY performance_rank DESC, pos DESC LIMIT 1),
c AS (SELECT *, round(work + games - media - archive + top - performance_rank, 6) AS score FROM sd, best WHERE eligible_for_local_target AND mount_point <> target AND performance_rank < top
      AND work + games > media + archive + 0.25 ORDER BY score DESC, pos LIMIT 1)
SELECT 'active-workload-placement' AS id, round(least(0.65 + 0.1 * score, 0.92), 6)::DOUBLE AS confidence, target AS target_mount, NULL::BIGINT AS space_saving_bytes, 'low' AS risk_level FROM c""")
def active_placement(spark, d) -> DataFrame:
    return _rule(rules.active_workload_placement, a.tables(spark, d, "disks", "categories"))


@query(f"""WITH {a.SCORES}, c AS (SELECT sd.*, work + games AS active, media + archive + backup AS cold FROM sd JOIN paths ON root_path = mount_point
      WHERE eligible_for_local_target AND used_bytes > 0 AND total_size_bytes / used_bytes >= 0.35)
SELECT 'consolidation-opportunity' AS id, 0.74::DOUBLE AS confidence, t.mount_point AS target_mount, s.used_bytes AS space_saving_bytes, 'medium' AS risk_level FROM c s JOIN c t ON s.mount_point <> t.mount_point
WHERE s.used_bytes >= 53687091200 AND NOT (s.active > s.cold + 0.25 AND t.cold > t.active + 0.25 AND t.performance_rank <= s.performance_rank) AND t.free_space_bytes > floor(s.used_bytes * 1.25)
ORDER BY s.used_bytes DESC, s.pos, t.pos LIMIT 1""")
def consolidation_pair(spark, d) -> DataFrame:
    return _rule(rules.consolidation_opportunity, a.tables(spark, d, "disks", "categories", "paths"))


@query(f"""WITH {a.SCORES} SELECT 'risky-disk-' || regexp_replace(mount_point, '[^A-Za-z0-9]', '-', 'g') AS id, 0.82::DOUBLE AS confidence, {_NONE}, 'high' AS risk_level FROM sd
WHERE locality_class IN ('local_physical', 'unknown') AND total_space_bytes > 0 AND {_FREE} <= 0.12 AND round(work + games + media, 6) >= 0.8 AND backup < 0.6""")
def risky_disks(spark, d) -> DataFrame:
    return _rule(rules.risky_disk, a.tables(spark, d, "disks", "categories"))


@query(f"""WITH {a.SCORES} SELECT 'backup-gap' AS id, 0.8::DOUBLE AS confidence, {_NONE}, 'high' AS risk_level FROM (
SELECT bool_or(round(s.work, 6) >= 0.5) AS w, bool_or(round(s.backup, 6) >= 0.5) AS b FROM scores s JOIN enriched e ON e.mount_point = s.mount_point
WHERE (eligible_for_local_target OR is_os_drive) AND pos % 6 <> 2 AND pos % 8 <> 2) WHERE w AND NOT b""")
def backup_gap(spark, d) -> DataFrame:
    """Of a scan without the disks that are named for backups."""
    t = a.tables(spark, d, "disks", "categories")
    kept = t["disks"].where("pos % 6 <> 2 AND pos % 8 <> 2")
    return _rule(rules.backup_gap, t | {"disks": kept, "categories": t["categories"].join(kept.select(F.col("mount_point").alias("disk_mount")), "disk_mount", "left_semi")})


@query(f"""WITH {a.DUPS} SELECT 'duplicate-cleanup-candidate' AS id, 0.7::DOUBLE AS confidence, NULL::VARCHAR AS target_mount, w::BIGINT AS space_saving_bytes, 'medium' AS risk_level FROM (
SELECT sum(total_wasted_bytes * 1048576) AS w FROM dups WHERE intent = 'likely_redundant' AND total_wasted_bytes * 1048576 >= 67108864) WHERE w >= 268435456""")
def duplicate_cleanup(spark, d) -> DataFrame:
    return _rule(rules.duplicate_cleanup, a.tables(spark, d, "duplicate_groups"))


@query(f"""WITH {a.SCORES} SELECT 'os-headroom' AS id, CASE WHEN round(media + archive, 6) > 0.6 THEN 0.86 ELSE 0.72 END::DOUBLE AS confidence, {_NONE}, 'high' AS risk_level FROM sd
WHERE is_os_drive AND total_space_bytes > 0 AND {_FREE} < 0.15""")
def os_headroom(spark, d) -> DataFrame:
    return _rule(rules.os_headroom, a.tables(spark, d, "disks", "categories"))


@query(f"""WITH {a.ENRICHED} SELECT 'cloud-backed-target-exclusion' AS id, 0.95::DOUBLE AS confidence, {_NONE}, 'low' AS risk_level FROM enriched WHERE locality_class = 'cloud_backed' HAVING count(*) > 0""")
def cloud_notice(spark, d) -> DataFrame:
    return _rule(rules.cloud_exclusion_notice, a.tables(spark, d, "disks"))


@query(f"""WITH {a.FILES}{a.EXTS} SELECT kind, sum(size_bytes)::BIGINT AS bytes, count(*)::BIGINT AS directories FROM (
SELECT CASE WHEN path LIKE '%/en' THEN 'node_modules' WHEN path LIKE '%/de' THEN 'target' END AS kind, size_bytes FROM dirs) WHERE kind IS NOT NULL GROUP BY kind""")
def artifact_cleanup(spark, d) -> DataFrame:
    dirs = usage.top_directories(a.files(spark, d))
    named = dirs.withColumn("path", F.regexp_replace(F.regexp_replace("path", "/en$", "/node_modules"), "/de$", "/target"))
    return rules.build_artifacts(named).drop("scan_id")


@query(f"""WITH {a.FILES}{a.EXTS} SELECT CASE WHEN path LIKE '%/fr' THEN 'french-cache' ELSE 'spanish-cache' END AS id, sum(size_bytes)::BIGINT AS bytes FROM dirs
WHERE path IN ('/src0/fr', '/src1-photos/es', '/src2-backup/es') GROUP BY 1""")
def cache_cleanup(spark, d) -> DataFrame:
    targets = spark.createDataFrame([("french-cache", "/src0/fr"), ("spanish-cache", "/src1-photos/es"), ("spanish-cache", "/src2-backup/es")], "id string, path string")
    return rules.cache_sizes(usage.top_directories(a.files(spark, d)), targets).drop("scan_id")


@query(f"""WITH {a.PROBES} SELECT mount_point, total_size_bytes AS observed_bytes, round(total_size_bytes / used_bytes, 6) AS coverage, total_size_bytes / used_bytes >= 0.35 AS covered FROM probes JOIN paths ON root_path = mount_point""")
def observed_coverage(spark, d) -> DataFrame:
    return rules.coverage(a.enriched(spark, d), a.paths(spark, d)).select("mount_point", "observed_bytes", r6("coverage"), "covered")


_FOUND = (("active_workload_placement", "active_placement"), ("consolidation_opportunity", "consolidation_pair"), ("risky_disk", "risky_disks"), ("backup_gap", "backup_gap"), ("duplicate_cleanup", "duplicate_cleanup"),
          ("os_headroom", "os_headroom"), ("cloud_exclusion_notice", "cloud_notice"))
#: The rules in order, with what those of them find that look at these tables, and whether the target's role is in the way.
_BUNDLE = "WITH found AS (" + " UNION ALL ".join(
    f"SELECT {k} AS rule_pos, id, confidence, target_mount FROM ({SQL[q].replace(' AND pos % 6 <> 2 AND pos % 8 <> 2', '')})" for k, (_, q) in enumerate(_FOUND)) + f"""),
rules AS (SELECT unnest({[r for r, _ in _FOUND] + ["dev_artifacts", "system_caches", "trend_analyzer"]}) AS rule_id, unnest(range(10)) AS rule_pos),
c AS (SELECT *, (row_number() OVER (ORDER BY rule_pos, CASE WHEN rule_pos = 2 THEN regexp_extract(id, '[0-9]+')::INT ELSE 0 END) - 1)::INT AS pos FROM found),
role AS (SELECT mount_point AS target_mount, role FROM ({SQL['disk_roles']})),
j AS (SELECT c.*, coalesce(rule_pos = 0 AND role IN ('media_library', 'archive', 'backup_target'), false) AS refused FROM c LEFT JOIN role USING (target_mount))"""


@query(f"""{_BUNDLE}, out_of AS (SELECT count(*) AS n FROM ({SQL['target_eligibility']}) WHERE NOT eligible_for_local_target)
SELECT pos, id, confidence, target_mount, true AS policy_safe, 'safe_target_policy,safe_target_policy' || CASE WHEN rule_pos = 0 THEN ',role_aware_target_policy' ELSE '' END AS applied,
CASE WHEN target_mount IS NOT NULL THEN 'disk,directory' WHEN rule_pos = 4 THEN 'duplicate_group' WHEN rule_pos = 6 THEN array_to_string(list_transform(range(least(n, 2)), lambda x: 'disk'), ',') ELSE 'other' END AS evidence
FROM j, out_of WHERE NOT refused""")
def recommendation_bundle(spark, d) -> DataFrame:
    out = policy.recommend(a.tables(spark, d), small=True)["recommendations"]
    return out.select("pos", "id", r6("confidence"), "target_mount", "policy_safe", F.array_join("policy_rules_applied", ",").alias("applied"), F.array_join("evidence.kind", ",").alias("evidence"))


@query(f"""{_BUNDLE}, t AS (
SELECT rule_pos AS a, rule_id, any_value(id) AS id, avg(confidence) AS confidence FROM rules LEFT JOIN j USING (rule_pos) GROUP BY ALL
UNION ALL SELECT 1000, 'role_aware_target_policy', id, NULL FROM j WHERE refused)
SELECT (row_number() OVER (ORDER BY a) - 1)::INT AS pos, rule_id, CASE WHEN a = 1000 THEN 'rejected' WHEN id IS NULL THEN 'skipped' ELSE 'emitted' END AS status, CASE WHEN a <> 2 THEN id END AS recommendation_id,
round(confidence, 6) AS confidence FROM t""")
def rule_traces(spark, d) -> DataFrame:
    return policy.recommend(a.tables(spark, d), small=True)["rule_traces"].select("pos", "rule_id", "status", "recommendation_id", r6("confidence"))


@query(f"""{_BUNDLE} SELECT pos, CASE rule_pos WHEN 0 THEN 'Check that the target has room.' WHEN 3 THEN 'Make sure that a second copy exists.' WHEN 4 THEN 'Pick the copy that counts.' ELSE 'Look at the evidence.' END AS first_step, 2 AS steps,
CASE WHEN rule_pos = 2 THEN (SELECT any_value(mount_point || ' has ' || printf('%.1f%%', round(free_space_bytes / total_space_bytes * 100, 1)) || ' left and no sign of a backup.') FROM (WITH {a.PROBES} SELECT * FROM probes) p
  WHERE 'risky-disk-' || regexp_replace(p.mount_point, '[^A-Za-z0-9]', '-', 'g') = j.id) END AS risky_rationale,
CASE WHEN target_mount IS NOT NULL THEN (SELECT any_value(name) FROM (WITH {a.PROBES} SELECT * FROM probes) p WHERE p.mount_point = j.target_mount) END AS disk_named FROM j WHERE NOT refused""")
def evidence_and_steps(spark, d) -> DataFrame:
    out = policy.recommend(a.tables(spark, d), small=True)["recommendations"]
    return out.select("pos", F.col("next_steps")[0].alias("first_step"), F.size("next_steps").alias("steps"), F.when(F.col("id").startswith("risky"), F.col("rationale")).alias("risky_rationale"),
                      F.when(F.col("target_mount").isNotNull(), F.substring_index(F.filter("evidence", lambda e: e["kind"] == "disk")[0]["detail"], " | ", 1)).alias("disk_named"))


# --- policy, scenarios, evaluation


_JUDGED = f"""{a.ROLES}, {a.RECS}, j AS (
  SELECT recs.*, roles.mount_point IS NOT NULL AS found, coalesce(roles.eligible_for_local_target, false) AS ok, roles.role,
         recs.target_mount IS NULL OR coalesce(roles.eligible_for_local_target, false) AS safe
  FROM recs LEFT JOIN roles ON roles.mount_point = recs.target_mount),
jj AS (SELECT *, safe AND NOT (id = 'active-workload-placement' AND target_mount IS NOT NULL AND coalesce(role IN ('media_library', 'archive', 'backup_target'), false)) AS allowed FROM j)"""


def _adapter_recs(spark, d) -> tuple[DataFrame, DataFrame]:
    recs = a.recommendations(spark, d).drop("policy_safe")
    months = recs.select("scan_id").distinct()
    return recs, months.crossJoin(a.tables(spark, d, "disks")["disks"].drop("scan_id"))  # the disks of each month's scan: a few dozen rows each


@query(f"""WITH {_JUDGED} SELECT scan_id, pos, 'safe_target_policy' AS policy_id, id AS recommendation_id, CASE WHEN safe THEN 'allowed' ELSE 'blocked' END AS action FROM jj
UNION ALL SELECT scan_id, pos, 'role_aware_target_policy', id, CASE WHEN allowed THEN 'allowed' ELSE 'blocked' END FROM jj WHERE safe AND target_mount IS NOT NULL AND id = 'active-workload-placement'
UNION ALL SELECT scan_id, pos + 1000000, 'contradiction_detector', id, 'blocked' FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, id ORDER BY pos) AS k FROM jj WHERE allowed) WHERE k > 1""")
def policy_decisions(spark, d) -> DataFrame:
    recs, disks = _adapter_recs(spark, d)
    return policy.enforce(recs, disks)["policy_decisions"].select("scan_id", "pos", "policy_id", "recommendation_id", "action")


@query(f"WITH {_JUDGED} SELECT scan_id, (count(*) - count(DISTINCT id))::BIGINT AS contradiction_count FROM jj WHERE allowed GROUP BY scan_id HAVING count(*) > count(DISTINCT id)")
def contradictions(spark, d) -> DataFrame:
    recs, disks = _adapter_recs(spark, d)
    return policy.enforce(recs, disks)["contradictions"]


@query(f"""WITH {a.RECS}, s AS (SELECT unnest(['conservative', 'balanced', 'aggressive']) AS scenario_id, unnest([['low'], ['low', 'medium'], ['low', 'medium', 'high']]) AS risks),
m AS (SELECT DISTINCT scan_id FROM recs),
b AS (SELECT scan_id, count(DISTINCT id) FILTER (WHERE pos % 7 = 0)::BIGINT AS n FROM recs GROUP BY scan_id)
SELECT m.scan_id, s.scenario_id, count(r.id)::BIGINT AS recommendation_count, coalesce(sum(r.space_saving_bytes), 0)::BIGINT AS projected_space_saving_bytes,
       count(*) FILTER (WHERE r.risk_level = 'low')::BIGINT AS risk_low, count(*) FILTER (WHERE r.risk_level = 'medium')::BIGINT AS risk_medium, count(*) FILTER (WHERE r.risk_level = 'high')::BIGINT AS risk_high,
       coalesce(any_value(b.n), 0)::BIGINT AS blocked_recommendation_count
FROM m CROSS JOIN s LEFT JOIN recs r ON r.scan_id = m.scan_id AND r.policy_safe AND list_contains(s.risks, r.risk_level) LEFT JOIN b ON b.scan_id = m.scan_id GROUP BY ALL""")
def scenario_plan(spark, d) -> DataFrame:
    recs = a.recommendations(spark, d)
    decisions = recs.select("scan_id", F.col("id").alias("recommendation_id"), F.when(F.col("pos") % 7 == 0, "blocked").otherwise("allowed").alias("action"))
    return scenario.plan(recs.select("scan_id"), recs, decisions).select("scan_id", "scenario_id", "recommendation_count", "projected_space_saving_bytes", "risk_low", "risk_medium", "risk_high", "blocked_recommendation_count")


@query(f"""WITH {a.RECS}, o AS (SELECT scan_id, list(id ORDER BY pos, id) AS ids, count(*) FILTER (WHERE NOT policy_safe)::BIGINT AS unsafe FROM recs GROUP BY scan_id)
SELECT scan_id, round(len(list_filter(ids[1:3], lambda x: list_contains(['active-workload-placement', 'rec-1', 'rec-2', 'rec-3'], x))) / least(len(ids), 3), 6) AS precision_at_3, list_contains(ids, 'rec-49') AS forbidden, unsafe FROM o""")
def eval_precision_at_3(spark, d) -> DataFrame:
    recs = a.recommendations(spark, d)
    want = F.array(*map(F.lit, ("active-workload-placement", "rec-1", "rec-2", "rec-3")))
    cases = recs.select("scan_id").distinct().withColumns({"expected_top_ids": want, "forbidden_ids": F.array(F.lit("rec-49"))})
    return evaluate.case_results(cases, recs).select("scan_id", r6("precision_at_3"), (F.size("forbidden_hits") > 0).alias("forbidden"), "unsafe")


@query(f"WITH {a.RECS} SELECT pos, id, title FROM recs WHERE (contains(lower(title), 'urgent') OR contains(lower(rationale), 'urgent') OR contains(lower(id), 'urgent')) AND policy_safe AND kind = 'disk'")
def ui_filter_recs(spark, d) -> DataFrame:
    return filters.filter_recommendations(a.recommendations(spark, d), "Urgent ", "safe", "disk").select("pos", "id", "title")


@query(f"WITH {a.RECS} SELECT coalesce(risk_level, 'all') AS status, count(*)::BIGINT AS traces FROM recs GROUP BY ROLLUP (risk_level)")
def trace_status_counts(spark, d) -> DataFrame:
    return filters.trace_status_counts(a.recommendations(spark, d).withColumnRenamed("risk_level", "status"))


@query("""SELECT scan_id, generated_at, recommendation_count FROM (SELECT strftime(o_orderdate, '%Y-%m') AS scan_id, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS generated_at, count(*)::BIGINT AS recommendation_count
FROM orders GROUP BY 1) ORDER BY generated_at DESC LIMIT 10""")
def report_index_latest(spark, d) -> DataFrame:
    """A report a month goes through the store; the latest ten of its index."""
    o = a.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("scan_id")).agg(s.utc_text(F.max("o_orderdate")).alias("generated_at"), F.count(F.lit(1)).alias("n"))
    rec = F.from_json(F.lit('{"recommendations": [{"id": "x"}]}'), schemas.REPORT_SCHEMA)["recommendations"][0]
    # a month's recommendations come in parts, dealt over all tasks, so no row or task has them all
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / ReportTable.PIECE))).alias("part")
    parts = o.select("scan_id", "generated_at", "n", part).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "scan_id", "part")
    some = F.least(F.col("n") - F.col("part") * ReportTable.PIECE, F.lit(ReportTable.PIECE)).cast("int")
    made = parts.select("scan_id", "part", "generated_at", F.lit("1.2.0").alias("report_version"), F.array_repeat(rec, some).alias("recommendations"))
    store = ReportTable(spark, scratch(spark, "months"))
    store.put(made)
    return store.index().select("scan_id", "generated_at", "recommendation_count").orderBy(F.desc("generated_at")).limit(10)


# --- scalar functions and hints


_SIZE = """CASE WHEN {0} >= 1099511627776 THEN printf('{1}', {0} / 1099511627776) || ' TB' WHEN {0} >= 1073741824 THEN printf('{1}', {0} / 1073741824) || ' GB'
WHEN {0} >= 1048576 THEN printf('{1}', {0} / 1048576) || ' MB' WHEN {0} >= 1024 THEN printf('{1}', {0} / 1024) || ' KB' ELSE {2} END"""
_ROUND = """CASE WHEN {0} >= 1099511627776 THEN printf('{1} TB', round({0} / 1099511627776, {2})) WHEN {0} >= 1073741824 THEN printf('{1} GB', round({0} / 1073741824, {2}))
WHEN {0} >= 1048576 THEN printf('{1} MB', round({0} / 1048576, {2})) WHEN {0} >= 1024 THEN printf('{1} KB', round({0} / 1024, {2})) END"""
_SHOWN = f"""CASE WHEN x IS NULL OR x <= 0 THEN 'n/a' WHEN x < 1024 THEN printf('%.0f B', x::DOUBLE)
WHEN x / (CASE WHEN x >= 1099511627776 THEN 1099511627776 WHEN x >= 1073741824 THEN 1073741824 WHEN x >= 1048576 THEN 1048576 ELSE 1024 END) >= 100
THEN {_ROUND.format('x', '%.0f', 0)} ELSE {_ROUND.format('x', '%.1f', 1)} END"""
_NUMBERS = "SELECT o_orderkey AS k, ((round(o_totalprice)::BIGINT << (o_orderkey % 25)::INT) - (CASE WHEN o_orderkey % 11 = 0 THEN round(o_totalprice)::BIGINT << (o_orderkey % 25)::INT ELSE 0 END))::BIGINT AS n FROM orders"


def _numbers(spark, d) -> DataFrame:
    """Sizes from nothing to terabytes."""
    n = F.expr("shiftleft(cast(round(o_totalprice) as bigint), cast(o_orderkey % 25 as int))")
    return a.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 11 == 0, F.lit(0).cast("bigint")).otherwise(n).alias("n"))


@query(f"""WITH t AS ({_NUMBERS}), u AS (SELECT k, n, CASE WHEN k % 13 = 0 THEN NULL ELSE n END AS x, n AS y FROM t)
SELECT k, CASE WHEN n = 0 THEN '0 B' ELSE {_SIZE.format('n', '%.1f', "printf('%.1f B', n::DOUBLE)")} END AS human, {_SHOWN} AS shown FROM u""")
def size_texts(spark, d) -> DataFrame:
    t = _numbers(spark, d)
    return t.select("k", s.human_bytes(F.col("n")).alias("human"), s.display_bytes(F.when(F.col("k") % 13 != 0, F.col("n"))).alias("shown"))


@query("""SELECT o_orderkey AS k, printf('%.1f%%', (0.5 + (o_orderkey % 5) / 10)::DOUBLE * 100) AS confidence, CASE WHEN o_orderkey % 40 <= 1 THEN 'day' ELSE (o_orderkey % 40) || ' days' END AS days,
CASE WHEN d = 0 THEN '0 B' ELSE (CASE WHEN d > 0 THEN '+' ELSE '-' END) || (CASE WHEN abs(d) >= 1024 THEN (CASE WHEN abs(d) / 1024 >= 100 THEN printf('%.0f KB', round(abs(d) / 1024)) ELSE printf('%.1f KB', round(abs(d) / 1024, 1)) END)
ELSE printf('%.0f B', abs(d)::DOUBLE) END) END AS delta, greatest(o_custkey - o_orderkey, 0)::BIGINT AS used FROM (SELECT *, ((o_custkey % 997) * 1000 - (o_orderkey % 31) * 20000)::BIGINT AS d FROM orders)""")
def signed_and_percent_texts(spark, d) -> DataFrame:
    k, delta = F.col("o_orderkey"), (F.col("o_custkey") % 997) * 1000 - (F.col("o_orderkey") % 31) * 20000
    return a.table(spark, d, "orders").select(k.alias("k"), s.display_confidence(F.lit(0.5) + (k % 5) / 10).alias("confidence"), s.human_days((k % 40).cast("bigint")).alias("days"),
                                              s.display_signed_bytes(s.signed_delta((F.col("o_orderkey") % 31) * 20000, (F.col("o_custkey") % 997) * 1000)).alias("delta"), s.used_space(F.col("o_custkey"), k).cast("bigint").alias("used"))


_MOUNTS = "['c:', ' D:\\', 'e:/data', '/', '/home/', ' /mnt/x ', 'f:\\Games', '//nas/share/']"


@query(f"""WITH t AS (SELECT o_orderkey AS k, ({_MOUNTS})[(o_orderkey % 8 + 1)::INT] AS m FROM orders), u AS (SELECT k, m, translate(trim(m), '/', '\\') AS w FROM t),
v AS (SELECT k, m, CASE WHEN regexp_full_match(w, '.:') THEN w || '\\' ELSE w END AS w FROM u)
SELECT k, CASE WHEN regexp_matches(w, '^.:') THEN upper(w[1]) || w[2:] ELSE w END AS windows, CASE WHEN trim(m) = '/' THEN '/' ELSE rtrim(trim(m), '/') END AS unix,
CASE WHEN regexp_matches(trim(m), '^[A-Za-z]:([\\/]|$)') THEN upper(w[1]) || w[2:] ELSE CASE WHEN trim(m) = '/' THEN '/' ELSE rtrim(trim(m), '/') END END AS same FROM v""".replace("\\\\", "\\").replace("([\\/]", "([\\\\/]"))
def mount_forms(spark, d) -> DataFrame:
    m = F.element_at(F.array(*map(F.lit, ("c:", " D:\\", "e:/data", "/", "/home/", " /mnt/x ", "f:\\Games", "//nas/share/"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    t = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), m.alias("m"))
    return t.select("k", s.windows_mount(F.col("m")).alias("windows"), s.unix_mount(F.col("m")).alias("unix"), s.mount_key(F.col("m")).alias("same"))


@query("""SELECT p_partkey AS k, nullif(trim(CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE ' ' || p_brand END), '') AS own,
CASE p_partkey % 8 WHEN 0 THEN 'nvme' WHEN 1 THEN 'usb' WHEN 2 THEN 'sata' WHEN 3 THEN 'sata' WHEN 4 THEN 'virtio' WHEN 5 THEN 'network' WHEN 6 THEN 'sata' END AS bus,
CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true END AS spins, CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false END AS media_spins FROM part""")
def hint_words(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    bus = pick("PCIe NVMe", " USB 3 ", "SATA", "iSCSI", "virtio-blk", "NFS", "SAS", "?")
    return a.table(spark, d, "part").select(k.alias("k"), s.optional(F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand"))).alias("own"), s.interface(bus).alias("bus"),
                                            s.rotational(pick("true", "0", "YES", " no ", "2", "maybe", None)).alias("spins"), s.media_rotational(pick("SSD", "hdd", "Solid State", "tape")).alias("media_spins"))


@query("""WITH h AS (SELECT ps_key AS pos, m, CASE WHEN ps_key % 3 = 0 THEN NULL ELSE 'v' || (ps_key % 5) END AS vendor, CASE WHEN ps_key % 4 = 0 THEN NULL ELSE 'm' || (ps_key % 7) END AS model, ps_key % 2 = 0 AS rotational, (ps_key % 3)::DOUBLE AS c
FROM (SELECT l_orderkey * 10 + l_linenumber AS ps_key, '/d' || l_orderkey AS m FROM lineitem))
SELECT m AS mount_point, first(vendor ORDER BY c DESC, pos) FILTER (WHERE vendor IS NOT NULL) AS vendor, first(model ORDER BY c DESC, pos) FILTER (WHERE model IS NOT NULL) AS model, first(rotational ORDER BY c DESC, pos) AS rotational, max(c) AS confidence
FROM h GROUP BY m""")
def hint_upsert(spark, d) -> DataFrame:
    from .operators import disks

    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    h = a.table(spark, d, "lineitem").select(k.alias("pos"), F.concat(F.lit("/d"), F.col("l_orderkey").cast("string")).alias("mount_point"), F.when(k % 3 != 0, F.concat(F.lit("v"), (k % 5).cast("string"))).alias("vendor"),
                                             F.when(k % 4 != 0, F.concat(F.lit("m"), (k % 7).cast("string"))).alias("model"), F.lit(None).cast("string").alias("interface"), (k % 2 == 0).alias("rotational"), (k % 3).cast("double").alias("confidence"), F.lit("t").alias("source"))
    return disks.merge_hints(h).select("mount_point", "vendor", "model", "rotational", "confidence")


@query(f"""WITH {a.ENRICHED}, h AS (SELECT pos, mount_point, pos % 2 = 0 AS rota, 'Maker ' || pos AS maker FROM probes WHERE pos % 3 = 0)
SELECT e.mount_point, coalesce(h.maker, e.vendor) AS vendor, CASE WHEN e.storage_type = 'unknown' AND h.rota IS NOT NULL THEN (CASE WHEN h.rota THEN 'hdd' ELSE 'ssd' END) ELSE e.storage_type END AS storage_type,
coalesce(h.rota, CASE e.disk_kind WHEN 'hdd' THEN true WHEN 'ssd' THEN false END) AS rotational, h.pos IS NOT NULL AS noted FROM enriched e LEFT JOIN h ON h.mount_point = e.mount_point""")
def disks_with_hints(spark, d) -> DataFrame:
    """Each mount has two hint rows, of which the second says less; a disk stays one row."""
    from .operators import disks

    p = a.probes(spark, d)
    h = p.where("pos % 3 = 0").select("pos", "mount_point", F.concat(F.lit("Maker "), F.col("pos").cast("string")).alias("vendor"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("interface"),
                                      (F.col("pos") % 2 == 0).alias("rotational"), F.lit(0.9).alias("confidence"), F.lit("t").alias("source"))
    both = h.unionByName(h.withColumns({"vendor": F.lit("other"), "rotational": ~F.col("rotational"), "confidence": F.lit(0.7), "mount_point": F.concat("mount_point", F.lit("/"))}))
    out = disks.enrich(p, both, os_mount="/src3-projects")
    return out.select("mount_point", "vendor", "storage_type", "rotational", (F.size("metadata_notes") > 0).alias("noted"))


@query("""WITH n AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS v, CASE o_orderkey % 4 WHEN 0 THEN 'nvme' WHEN 1 THEN 'usb' END AS t, o_orderkey % 5 = 0 AS r, l_returnflag AS m,
  CASE WHEN l_linenumber % 2 = 1 THEN 'own' END AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT k, (CASE WHEN i % 2 = 1 THEN '/d' ELSE '/x' END) || k || '/' || i AS mount_point, coalesce(w, v) AS vendor, m AS model, t AS interface, r AS rotational FROM n
UNION ALL SELECT k, '/leaf/' || k || '/' || i, coalesce(w, v), m, t, false FROM n WHERE i % 3 = 0)
SELECT k::VARCHAR AS doc, mount_point, vendor, model, interface, rotational, round(least(0.70 + 0.05 * (2 + (vendor IS NOT NULL)::INT + (interface IS NOT NULL)::INT), 0.9), 6)::DOUBLE AS confidence FROM a""")
def device_documents(spark, d) -> DataFrame:
    """Orders as disks and their lines as partitions, some with one below, in JSON documents that are taken apart again."""
    from .sources import devices

    o = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise(" ").alias("v"),
                                           F.when(F.col("o_orderkey") % 4 == 0, "nvme").when(F.col("o_orderkey") % 4 == 1, "usb").alias("t"), (F.col("o_orderkey") % 5 == 0).alias("r"))
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    name = lambda p: F.concat(F.lit(p), k.cast("string"), F.lit("/"), i.cast("string"))
    leaf = F.array(F.struct(name("/leaf/").alias("mountpoint"), F.lit("0").alias("rota")))
    line = F.struct(F.when(i % 2 == 1, name("/d")).alias("mountpoint"), F.when(i % 2 == 0, F.array(name("/x"), F.lit(None))).alias("mountpoints"), F.when(i % 2 == 1, "own").alias("vendor"),
                    F.col("l_returnflag").alias("model"), F.when(i % 3 == 0, leaf).alias("children"))
    lines = a.table(spark, d, "lineitem").groupBy(k.alias("k")).agg(F.collect_list(line).alias("children"))  # the few lines of an order
    disk = F.struct(F.col("v").alias("vendor"), F.col("t").alias("tran"), F.col("r").alias("rota"), "children")
    docs = o.join(lines, "k").select(F.col("k").cast("string").alias("doc"), F.to_json(F.struct(F.array(disk).alias("blockdevices"))).alias("text"))
    return devices.lsblk_rows(docs).select("doc", "mount_point", "vendor", "model", "interface", "rotational", r6("confidence"))


@query("""SELECT p_partkey::VARCHAR AS doc, upper(chr((97 + p_partkey % 26)::INT)) || ':' || chr(92) AS mount_point, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS model,
CASE p_partkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS rotational, round(0.72 + 0.06 * ((p_partkey % 2 = 0)::INT + (p_partkey % 3 <> 2)::INT), 6)::DOUBLE AS confidence FROM part""")
def device_records(spark, d) -> DataFrame:
    """Parts as records of a captured CIM query, one object or an array of one."""
    from .sources import devices

    k = F.col("p_partkey")
    record = F.to_json(F.struct(F.concat(F.chr((97 + k % 26).cast("int")), F.lit(":")).alias("DriveLetter"), F.when(k % 2 == 0, F.col("p_brand")).alias("Model"), F.when(k % 3 == 0, "SSD").when(k % 3 == 1, "Hard disk").alias("MediaType")))
    docs = a.table(spark, d, "part").select(k.cast("string").alias("doc"), F.when(k % 5 == 0, F.concat(F.lit("["), record, F.lit("]"))).otherwise(record).alias("text"))
    return devices.cim_rows(docs).select("doc", "mount_point", "model", "rotational", r6("confidence"))


@query("""SELECT doc_id, CASE WHEN regexp_full_match(i, '[A-Za-z0-9_-]+') AND NOT starts_with(i, 'scan-') THEN i ELSE 'scan-' || sha256(i) END AS stem, replace(replace(replace(i, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS shown,
replace(i, '\\', '/') AS cached, regexp_replace(i, '[^A-Za-z0-9]', '-', 'g') AS slug, regexp_replace(i, '[^A-Za-z0-9]', '', 'g') AS bare
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'scan-' || doc_id WHEN 1 THEN source || '_' || doc_id WHEN 2 THEN 'a\\b/' || doc_id WHEN 3 THEN 'x' || chr(9) || doc_id || chr(10) ELSE 'ü ' || doc_id END AS i FROM documents)""".replace("\\\\", "\\"))
def store_names(spark, d) -> DataFrame:
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    i = F.when(k % 5 == 0, F.concat(F.lit("scan-"), n)).when(k % 5 == 1, F.concat("source", F.lit("_"), n)).when(k % 5 == 2, F.concat(F.lit("a\\b/"), n)).when(k % 5 == 3, F.concat(F.lit("x\t"), n, F.lit("\n"))).otherwise(F.concat(F.lit("ü "), n))
    t = a.table(spark, d, "documents").select("doc_id", i.alias("i"))
    c = F.col("i")
    return t.select("doc_id", s.safe_stem(c).alias("stem"), s.escape_lines(c).alias("shown"), s.cache_path(c).alias("cached"), F.regexp_replace(c, "[^A-Za-z0-9]", "-").alias("slug"), s.bare_id(c).alias("bare"))


@query("""SELECT event_id, greatest(epoch(TIMESTAMP '2024-01-20 00:00:00')::BIGINT - epoch(date_trunc('second', ts))::BIGINT, 0) AS age, greatest(epoch(TIMESTAMP '2024-01-20 00:00:00')::BIGINT - epoch(date_trunc('second', ts))::BIGINT, 0) > 86400 AS expired,
CASE WHEN event_id % 9 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS told FROM events""")
def cache_ages(spark, d) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    age = s.cache_age_seconds(now, F.col("ts"))
    text = F.when(F.col("event_id") % 9 == 0, "no time").otherwise(s.utc_text(F.col("ts")))
    return a.table(spark, d, "events").select("event_id", age.alias("age"), (age > 86400).alias("expired"), s.utc_text(s.utc_time(text)).alias("told"))


_STORED = """SELECT strftime(o_orderdate, '%Y-%m-%d') AS scan_id, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS generated_at, count(*)::BIGINT AS n, max(o_orderdate) AS t, sum(round(o_totalprice)::BIGINT)::BIGINT AS size
FROM orders GROUP BY 1"""


def _stored(spark, d) -> ReportTable:
    """A report a day of orders: all are put, those of even days are put again with a warning less, and Sundays go."""
    o = a.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("scan_id")).agg(
        s.utc_text(F.max("o_orderdate")).alias("generated_at"), F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("t"), F.sum(F.round("o_totalprice").cast("bigint")).alias("size"))
    scan = F.named_struct(F.lit("roots"), F.array("scan_id"), F.lit("backend"), F.when(F.dayofmonth("t") % 3 == 0, "pdu"))
    disk = F.named_struct(F.lit("mount_point"), F.lit("/d"), F.lit("total_space_bytes"), F.lit(1 << 34), F.lit("free_space_bytes"), (F.lit(1 << 34) - F.col("size")).cast("bigint"))
    made = o.select("scan_id", "generated_at", F.lit("1.2.0").alias("report_version"), F.array_repeat(F.lit(""), F.col("n").cast("int")).alias("warnings"), "t",
                    F.from_json(F.to_json(F.struct(scan.alias("scan"), F.array(disk).alias("disks"))), schemas.REPORT_SCHEMA).alias("j"))
    made = made.select("scan_id", "generated_at", "report_version", "warnings", "t", "j.scan", "j.disks", "j.paths")
    store = ReportTable(spark, scratch(spark, "reports"))
    store.put(made)
    store.put(made.where(F.dayofmonth("t") % 2 == 0).withColumn("warnings", F.slice("warnings", 2, 1 << 30)), imported=True, source="again")
    store.remove(made.where(F.dayofweek("t") == 1))
    return store


@query(f"""SELECT scan_id, generated_at, CASE WHEN day(t) % 3 = 0 THEN 'pdu' ELSE 'native' END AS backend, (n - CASE WHEN day(t) % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS warnings_count, day(t) % 2 = 0 AS imported
FROM ({_STORED}) WHERE dayofweek(t) <> 0""")
def stored_reports(spark, d) -> DataFrame:
    """The index of a store of many reports, after replacements and removals."""
    return _stored(spark, d).index().select("scan_id", "generated_at", "backend", "warnings_count", "imported")


@query(f"""WITH s AS (SELECT scan_id, 17179869184 - size AS free, row_number() OVER (ORDER BY generated_at, scan_id) - 1 AS k FROM ({_STORED}) WHERE dayofweek(t) <> 0)
SELECT k::INT AS snap_pos, scan_id, free::BIGINT AS free_space_bytes FROM s""")
def stored_snapshots(spark, d) -> DataFrame:
    """The history that the stored reports are."""
    store = _stored(spark, d)
    store.compact()
    return store.snapshots()[0].select("snap_pos", "scan_id", "free_space_bytes")


@query(f"""SELECT '- ' || scan_id || ', ' || generated_at || ', roots ' || scan_id || ', ' || backend || ', ' || warnings_count || ' warnings, 0 recommendations' || CASE WHEN imported THEN ', imported' ELSE '' END AS line FROM ({SQL['stored_reports']})""")
def report_lines(spark, d) -> DataFrame:
    return lines.report_lines(_stored(spark, d).index())


@query(f"""WITH {a.RECS} SELECT '- ' || risk_level || ' risk, ' || printf('%.2f', confidence::DOUBLE) || ', ' || CASE WHEN policy_safe THEN 'safe' ELSE 'blocked' END || ': ' || title || ' (' || rationale || ')' AS line FROM recs""")
def recommendation_lines(spark, d) -> DataFrame:
    return lines.recommendation_lines(a.recommendations(spark, d))


# --- differences and trends


@query(f"""WITH {a.SLICES} SELECT coalesce(l.root_path, r.root_path) AS mount_point, 'disk ' || coalesce(r.root_path, l.root_path) AS name, l.size AS left_free_space_bytes, r.size AS right_free_space_bytes,
coalesce(r.size, 0) - coalesce(l.size, 0) AS free_space_delta_bytes FROM l FULL JOIN r ON l.root_path = r.root_path WHERE coalesce(r.size, 0) <> coalesce(l.size, 0) OR l.size IS NULL OR r.size IS NULL""")
def disk_diff(spark, d) -> DataFrame:
    return diff.disk_diff(*a.order_slices(spark, d))


@query(f"""WITH {a.SLICES} SELECT coalesce(l.root_path, r.root_path) AS root_path, l.size AS left_size_bytes, r.size AS right_size_bytes, coalesce(r.size, 0) - coalesce(l.size, 0) AS size_delta_bytes,
l.n AS left_file_count, r.n AS right_file_count, coalesce(r.n, 0) - coalesce(l.n, 0) AS file_count_delta FROM l FULL JOIN r ON l.root_path = r.root_path
WHERE coalesce(r.size, 0) <> coalesce(l.size, 0) OR coalesce(r.n, 0) <> coalesce(l.n, 0) OR l.size IS NULL OR r.size IS NULL""")
def path_diff(spark, d) -> DataFrame:
    return diff.path_diff(*a.order_slices(spark, d))


_CHANGE = f"""WITH {a.RECS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, id ORDER BY pos) AS k FROM recs) WHERE k = 1),
x AS (SELECT id, confidence AS c, target_mount AS t, risk_level AS k, rationale AS w FROM f WHERE scan_id = '1998-01'), y AS (SELECT id, confidence AS c, target_mount AS t, risk_level AS k, rationale AS w FROM f WHERE scan_id = '1998-02'),
z AS (SELECT coalesce(x.id, y.id) AS id, x.id IS NULL AS new, y.id IS NULL AS gone, x.c AS c1, y.c AS c2, x.t AS t1, y.t AS t2, x.k AS k1, y.k AS k2, x.w AS w1, y.w AS w2 FROM x FULL JOIN y ON x.id = y.id)"""


@query(_CHANGE + """ SELECT id, 'added' AS change FROM z WHERE new UNION ALL SELECT id, 'removed' FROM z WHERE gone UNION ALL SELECT id, 'confidence_changed' FROM z WHERE abs(c2 - c1) > 0.001
UNION ALL SELECT id, 'target_changed' FROM z WHERE NOT new AND NOT gone AND t1 IS DISTINCT FROM t2 UNION ALL SELECT id, 'risk_changed' FROM z WHERE NOT new AND NOT gone AND k1 IS DISTINCT FROM k2
UNION ALL SELECT id, 'rationale_changed' FROM z WHERE NOT new AND NOT gone AND w1 IS DISTINCT FROM w2""")
def rec_changes(spark, d) -> DataFrame:
    first = policy.W.partitionBy("scan_id", "id").orderBy("pos")
    r = a.recommendations(spark, d).withColumn("k", F.row_number().over(first)).where("k = 1")
    return diff.recommendation_changes(r.where("scan_id = '1998-01'"), r.where("scan_id = '1998-02'")).select("id", "change")


@query(f"WITH {a.SNAPS} SELECT snap_pos, (row_number() OVER (ORDER BY snap_pos DESC))::INT AS rank FROM (SELECT DISTINCT snap_pos FROM snaps) ORDER BY snap_pos DESC LIMIT 2")
def latest_two_snapshots(spark, d) -> DataFrame:
    return trend.latest_two(a.snapshots(spark, d).select("snap_pos").distinct())


_LAST = f"WITH {a.SNAPS}, p AS (SELECT max(snap_pos) AS b FROM snaps), q AS (SELECT max(snap_pos) AS a FROM snaps, p WHERE snap_pos < b)"


@query(_LAST + """ SELECT 'disk-growth-' || regexp_replace(y.mount_point, '[^A-Za-z0-9]', '', 'g') AS id, y.mount_point, y.grown - x.grown AS growth_bytes, date_diff('day', x.day, y.day)::BIGINT AS days
FROM snaps x JOIN snaps y ON x.mount_point = y.mount_point, p, q WHERE x.snap_pos = a AND y.snap_pos = b AND abs(y.grown - x.grown) > 1073741824 AND (y.grown - x.grown) / y.total > 0.1""")
def trend_disk(spark, d) -> DataFrame:
    return trend.disk_growth(a.snapshots(spark, d)).select("id", "mount_point", "growth_bytes", "days")


@query(_LAST + """ SELECT 'path-growth-' || regexp_replace(y.mount_point, '[^A-Za-z0-9]', '', 'g') AS id, y.mount_point AS root_path, y.grown - x.grown AS growth_bytes, date_diff('day', x.day, y.day)::BIGINT AS days
FROM snaps x JOIN snaps y ON x.mount_point = y.mount_point, p, q WHERE x.snap_pos = a AND y.snap_pos = b AND y.grown - x.grown > 1073741824 AND (y.grown - x.grown) / greatest(x.grown, 1) > 0.1""")
def trend_path(spark, d) -> DataFrame:
    return trend.path_growth(a.snapshots(spark, d)).select("id", "root_path", "growth_bytes", "days")


_MOUNT_OF = {"/click": "/src0", "/error": "/src1-photos", "/purchase": "/src2-backup", "/signup": "/src3-projects", "/view": "/src5-archive"}
_MOUNTED = "(VALUES " + ", ".join(f"('{k}', '{v}', '{re.sub('[^A-Za-z0-9]', '', v)}')" for k, v in _MOUNT_OF.items()) + ") m(own, mount, bare)"


def _mounted_snapshots(spark, d) -> DataFrame:
    """The snapshots, as if their series were mounts of the adapter."""
    mount = F.coalesce(*(F.when(F.col("mount_point") == k, F.lit(v)) for k, v in _MOUNT_OF.items()))
    return a.snapshots(spark, d).withColumns({"mount_point": mount, "root_path": mount, "scan_id": F.lit("earlier")})


@query(f"""SELECT id, confidence, target_mount, policy_safe, evidence FROM ({SQL['recommendation_bundle']})
UNION ALL SELECT 'disk-growth-' || m.bare, 0.75, m.mount, true, 'disk,history_delta,directory' FROM ({SQL['trend_disk']}) g JOIN {_MOUNTED} ON m.own = g.mount_point
JOIN ({SQL['target_eligibility']}) e ON e.mount_point = m.mount WHERE e.eligible_for_local_target
UNION ALL SELECT 'path-growth-' || m.bare, 0.78, NULL, true, 'history_delta' FROM ({SQL['trend_path']}) g JOIN {_MOUNTED} ON m.own = g.root_path""")
def bundle_with_history(spark, d) -> DataFrame:
    """The bundle of a scan that has a history: growth is found, judged like the rest, and stands on its change."""
    snaps = landed(_mounted_snapshots(spark, d))
    out = policy.recommend(a.tables(spark, d) | {"disk_snapshots": snaps, "path_snapshots": snaps}, small=True)["recommendations"]
    return out.select("id", r6("confidence"), "target_mount", "policy_safe", F.array_join("evidence.kind", ",").alias("evidence"))


# --- events


def _events(spark, d) -> DataFrame:
    e = a.table(spark, d, "events")
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("scan_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("phase"), "value", "ts")


@query("SELECT 'user-' || user_id AS scan_id, event_type AS phase, count(*)::BIGINT AS events FROM events GROUP BY ALL")
def phase_counts(spark, d) -> DataFrame:
    return ev.phase_counts(_events(spark, d))


@query("SELECT 'user-' || user_id AS scan_id, event_id AS seq, event_type AS phase FROM events WHERE event_id > 500 AND user_id = 7")
def poll_from_seq(spark, d) -> DataFrame:
    return ev.poll(_events(spark, d), "user-7", 500).select("scan_id", "seq", "phase")


@query("SELECT scan_id, seq, phase FROM (SELECT 'user-' || user_id AS scan_id, event_id AS seq, event_type AS phase, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 12")
def tail_events(spark, d) -> DataFrame:
    return ev.tail(_events(spark, d)).select("scan_id", "seq", "phase")


@query("""SELECT user_id AS scan_id, event_id AS root_pos, (row_number() OVER w)::INT AS seq, (sum(1) OVER w)::BIGINT AS scanned_files, (sum(round(value)::BIGINT) OVER w)::BIGINT AS scanned_bytes
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_counters(spark, d) -> DataFrame:
    e = a.table(spark, d, "events").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("root_pos"), F.lit(1).cast("bigint").alias("file_count"), F.round("value").cast("bigint").alias("total_size_bytes"))
    return ev.running_counters(e).select("scan_id", "root_pos", "seq", "scanned_files", "scanned_bytes")


@query("SELECT 'user-' || user_id AS scan_id, count(*)::BIGINT AS total_events, bool_or(event_type = 'purchase') AS completed FROM events GROUP BY user_id")
def progress_summary(spark, d) -> DataFrame:
    e = _events(spark, d)
    return ev.progress_summary(e.withColumn("phase", F.when(F.col("phase") == "purchase", "done").otherwise(F.col("phase"))))


_STREAMED = """WITH e AS (SELECT 'user-' || user_id AS scan_id, event_id AS seq, CASE WHEN event_type = 'purchase' AND value > 30 THEN 'done' WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS phase,
  epoch_ms(date_trunc('second', ts)) AS ms, (event_id % 100)::BIGINT AS files FROM events),
m AS (SELECT max(ms) - 60000 AS mark FROM e)"""


@query(_STREAMED + """ SELECT scan_id, CASE arg_max(phase, seq) FILTER (WHERE phase IN ('done', 'failed')) WHEN 'done' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE
CASE WHEN max(ms) + 172800000 <= any_value(mark) THEN 'timed_out' ELSE 'running' END END AS status, arg_max(phase, seq) AS phase, max(seq) AS seq, count(*)::BIGINT AS events, max(files) AS scanned_files FROM e, m GROUP BY scan_id""")
def session_final_states(spark, d) -> DataFrame:
    """Events through a stream with keyed state and timers: two days without an event time a scan out."""
    own, folder = states.stream_session(spark), scratch(spark, "sessions")  # a pattern as path, since a stream takes one file only so
    e = own.readStream.schema(a.table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    phase = F.when((F.col("event_type") == "purchase") & (F.col("value") > 30), "done").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    e = e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("scan_id"), F.col("event_id").alias("seq"), phase.alias("phase"), s.utc_text(F.col("ts")).alias("timestamp"),
                 (F.col("event_id") % 100).cast("bigint").alias("scanned_files"), F.lit(0).cast("bigint").alias("scanned_bytes"), F.lit(0).cast("bigint").alias("errors"))
    states.drained(states.session_changes(e, 172_800_000, "1 minute"), f"{folder}/log", f"{folder}/checkpoint")
    return states.latest(spark.read.schema(states.SESSION).parquet(f"{folder}/log"), "scan_id").select("scan_id", "status", "phase", "seq", "events", "scanned_files")


def _grown(spark, d) -> tuple[DataFrame, DataFrame]:
    """Snapshots, written in three parts out of order, through the stream of last two states."""
    own, folder = states.stream_session(spark), scratch(spark, "growth")
    snaps = a.snapshots(spark, d)
    rows = states.snapshot_rows(snaps, snaps)
    for k in (2, 0, 1):
        rows.where(F.col("snap_pos") % 3 == k).write.mode("append").parquet(f"{folder}/snapshots")
    stream = own.readStream.schema(states.SNAPSHOT).parquet(f"{folder}/snapshots")
    states.drained(states.growth_changes(stream), f"{folder}/log", f"{folder}/checkpoint")
    return states.growth_of(states.latest(spark.read.schema(states.GROWTH).parquet(f"{folder}/log"), "series", "kind", "name"))


@query(SQL["trend_disk"])
def streamed_disk_growth(spark, d) -> DataFrame:
    return _grown(spark, d)[0].select("id", "mount_point", "growth_bytes", "days")


@query(SQL["trend_path"])
def streamed_path_growth(spark, d) -> DataFrame:
    return _grown(spark, d)[1].select("id", "root_path", "growth_bytes", "days")
