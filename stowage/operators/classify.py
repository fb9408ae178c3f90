"""Categories of paths and disks, and the role of each disk.

Every rule that fires is a row (target, category, delta, evidence); scores are sums over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_any
from ..schemas import CATEGORIES

LEAST = 0.35

# Category, weight, words (for paths: of the root, then of its directories).
PATH_NAMES = (
    ("games", 0.8, ("steam", "epic", "gog"), ("steamapps", "epic", "gog")),
    ("media", 0.75, ("dcim", "photos", "pictures", "videos"), ("dcim", "photos", "pictures", "videos")),
    ("backup", 0.9, ("backup", "time machine", "history", "snapshot"), ("backup", "time machine", "history", "snapshot")),
    ("work", 0.7, ("projects", "work", "documents", "repos"), ("projects", "work", "documents", "repos")),
    ("archive", 0.65, ("archive", "old", "cold"), ("archive", "old", "cold")),
)
GAME_WORDS = ("steam", "epic", "gog", "game", "games", "apps", "application")
BACKUP_WORDS = ("backup", "time machine", "history", "snapshot", "restore")
ARCHIVE_WORDS = ("archive", "cold", "old", "long-term")
DISK_NAMES = (
    ("media", 0.82, ("photos", "pictures", "media", "dcim", "video", "videos")), ("games", 0.85, GAME_WORDS), ("work", 0.35, GAME_WORDS),
    ("backup", 0.9, BACKUP_WORDS), ("work", 0.75, ("work", "project", "projects", "repo", "dev", "docs")), ("archive", 0.7, ARCHIVE_WORDS),
)
ROLE_LABELS = (
    ("games", 0.85, GAME_WORDS, "label:games_or_apps"), ("work", 0.35, GAME_WORDS, "label:games_or_apps"),
    ("media", 0.82, ("photos", "photo", "pictures", "media", "dcim", "video", "videos"), "label:media_or_photos"),
    ("backup", 0.9, BACKUP_WORDS, "label:backup"), ("archive", 0.75, ARCHIVE_WORDS, "label:archive"),
)
MEDIA_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "gif", "mp4", "mov", "mkv", "avi", "mp3", "flac")
WORK_EXTENSIONS = ("doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf", "md", "txt", "rs", "py", "ts", "js", "java")
ARCHIVE_EXTENSIONS = ("zip", "7z", "rar", "tar", "gz", "bak")
EXTENSION_RULES = (("media", 0.8, 0.1, MEDIA_EXTENSIONS), ("work", 0.75, 0.08, WORK_EXTENSIONS), ("archive", 0.7, 0.08, ARCHIVE_EXTENSIONS))
ELIGIBLE_ROLES = {
    "active_workload": ("active_workload", "games_library", "mixed"), "games_library": ("active_workload", "games_library", "mixed"),
    "media_library": ("media_library", "archive", "backup_target"), "backup_target": ("backup_target", "archive"),
    "archive": ("archive", "backup_target", "media_library"),
}
ANY_ROLE = ("active_workload", "games_library", "media_library", "archive", "backup_target", "mixed", "unknown")


def _signals(fired: list[tuple[Column, str, Column | float, str]]) -> Column:
    """The rules that fired as an array of (category, delta, evidence)."""
    return F.array_compact(F.array(*(
        F.when(hit, F.struct(F.lit(c).alias("category"), F.lit(d).cast("double").alias("delta"), F.lit(e).alias("evidence"))) for hit, c, d, e in fired)))


def path_signals(paths: DataFrame, directories: DataFrame, extensions: DataFrame) -> DataFrame:
    """paths: scan_id, root_path, disk_mount, file_count, stale_files, recent_files, type_total_bytes; directories and
    extensions: the retained rows of each root.  One row for each rule that fires."""
    key = ["scan_id", "root_path"]
    words = [F.bool_or(contains_any(F.lower("path"), w)).alias(f"_d{i}") for i, (_, _, _, w) in enumerate(PATH_NAMES)]
    p = paths.join(directories.groupBy(*key).agg(*words), key, "left")
    root = F.lower("root_path")
    fired = [(contains_any(root, w) | F.coalesce(f"_d{i}", F.lit(False)), c, d, f"name:{c}") for i, (c, d, w, _) in enumerate(PATH_NAMES)]
    n = F.greatest("file_count", F.lit(1))
    stale, recent = F.col("stale_files") / n, F.col("recent_files") / n
    fired += [(stale > 0.6, "archive", 0.4, "activity:stale"), (recent > 0.35, "work", 0.3, "activity:recent"), ((stale > 0.7) & (recent < 0.1), "backup", 0.2, "activity:dormant")]
    named = p.select(*key, "disk_mount", F.explode(_signals(fired)).alias("s")).select(*key, "disk_mount", "s.*")
    e = extensions.join(paths.select(*key, "disk_mount", "type_total_bytes"), key).withColumn("_r", F.col("bytes") / F.greatest("type_total_bytes", F.lit(1)))
    shares = [(F.col("extension").isin(*x) & (F.col("_r") >= least), c, w * F.col("_r"), f"extension:{c}") for c, w, least, x in EXTENSION_RULES]
    share = e.select(*key, "disk_mount", F.explode(_signals(shares)).alias("s")).select(*key, "disk_mount", "s.*")
    return named.unionByName(share).withColumnRenamed("root_path", "target")


def _scored(signals: DataFrame) -> DataFrame:
    """Sums of the signals by target and category that reach the threshold, confidence at most 1."""
    return signals.groupBy("scan_id", "target", "disk_mount", "category").agg(
        F.sum("delta").alias("score"), F.array_sort(F.collect_set("evidence")).alias("evidence")).where(F.round("score", 6) >= LEAST).select(
        "scan_id", "target", "disk_mount", "category", F.least("score", F.lit(1.0)).alias("confidence"), "evidence")


def categorize_paths(paths: DataFrame, directories: DataFrame, extensions: DataFrame) -> DataFrame:
    return _scored(path_signals(paths, directories, extensions))


def label_of(disks_name: Column, model: Column) -> Column:
    m = F.coalesce(model, F.lit(""))
    return F.lower(F.concat(F.coalesce(disks_name, F.lit("")), F.when(m != "", F.concat(F.lit(" "), m)).otherwise("")))


def categorize_disks(disks: DataFrame) -> DataFrame:
    label = label_of(F.col("name"), F.col("model"))
    fired = [(contains_any(label, w), c, d, f"label:{c}") for c, d, w in DISK_NAMES]
    rows = disks.select("scan_id", F.col("mount_point").alias("target"), F.col("mount_point").alias("disk_mount"), F.explode(_signals(fired)).alias("s"))
    return _scored(rows.select("scan_id", "target", "disk_mount", "s.*"))


def aggregate_by_disk(categories: DataFrame) -> DataFrame:
    """Mean confidence (at most 1) of the suggestions for each mount and category that reaches the threshold."""
    return categories.where(F.col("disk_mount").isNotNull()).groupBy("scan_id", "disk_mount", "category").agg(
        F.least(F.avg("confidence"), F.lit(1.0)).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
        F.count(F.lit(1)).alias("suggestions")).where(F.round("confidence", 6) >= LEAST).withColumn("target", F.col("disk_mount"))


def all_categories(paths: DataFrame, directories: DataFrame, extensions: DataFrame, disks: DataFrame) -> DataFrame:
    """Suggestions of paths, then of disks, then the means over both; all of them count from here on.  Ordered by
    confidence, category and target within a stage (pos is their order)."""
    from pyspark.sql import Window as W

    cols = ["scan_id", "target", "disk_mount", "category", "confidence", "evidence"]
    own = categorize_paths(paths, directories, extensions).select(*cols, F.lit(0).alias("stage"))
    both = own.unionByName(categorize_disks(disks).select(*cols, F.lit(1).alias("stage")))
    every = both.unionByName(aggregate_by_disk(both).select(*cols, F.lit(2).alias("stage")))
    return every.withColumn("pos", F.row_number().over(W.partitionBy("scan_id").orderBy("stage", F.desc("confidence"), "category", "target")) - 1)


def score_pivot(categories: DataFrame, mounts: DataFrame | None = None) -> DataFrame:
    """Summed confidence by mount, a column for each category (0 without one).  With mounts (scan_id, pos, mount_point),
    suggestions without a mount get that of their target first; those still without one are left out."""
    rows = categories
    if mounts is not None:
        from .mounts import match_mounts

        found = match_mounts(rows.select("scan_id", F.col("target").alias("_t")).distinct(), mounts, "_t", ("scan_id",))
        rows = rows.join(found.select("scan_id", F.col("_t").alias("target"), F.col("disk_mount").alias("_m")), ["scan_id", "target"], "left")
        rows = rows.withColumn("disk_mount", F.coalesce("disk_mount", "_m"))
    rows = rows.where(F.col("disk_mount").isNotNull())
    return rows.groupBy("scan_id", "disk_mount").agg(*(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("confidence"))), F.lit(0.0)).alias(c) for c in CATEGORIES))


def role(games: Column, work: Column, media: Column, archive: Column, backup: Column) -> Column:
    active, cold = games + work, media + archive + backup
    strong = sum((F.when(c >= 0.5, 1).otherwise(0) for c in (games, work, media, archive, backup)), F.lit(0))
    return (F.when((backup >= 0.85) & (backup > active + 0.2), "backup_target").when((media >= 0.8) & (media > active + 0.2), "media_library")
            .when((games >= 0.85) & (games >= work), "games_library").when((active >= 0.9) & (active > cold + 0.2), "active_workload")
            .when((archive >= 0.75) & (archive > active), "archive").when(strong >= 2, "mixed").otherwise("unknown"))


def eligible_roles(role_: Column) -> Column:
    out = None
    for name, roles in ELIGIBLE_ROLES.items():
        value = F.array(*map(F.lit, roles))
        out = F.when(role_ == name, value) if out is None else out.when(role_ == name, value)
    return out.otherwise(F.array(*map(F.lit, ANY_ROLE)))


def infer_roles(disks: DataFrame, categories: DataFrame) -> DataFrame:
    """disks with role, role_confidence, role_evidence, target_role_eligibility and the five scores behind them.  Scores
    are rounded to six places before they meet a threshold."""
    said = categories.where(F.col("disk_mount").isNotNull()).groupBy("scan_id", F.col("disk_mount").alias("mount_point")).agg(
        F.collect_set(F.concat(F.lit("category:"), "category", F.format_string(" conf:%.2f", F.col("confidence")))).alias("_said"))
    scores = score_pivot(categories).withColumnRenamed("disk_mount", "mount_point")
    d = disks.join(scores, ["scan_id", "mount_point"], "left").join(said, ["scan_id", "mount_point"], "left")
    label = label_of(F.col("name"), F.col("model"))
    bonus = {c: F.lit(0.0) for c in CATEGORIES}
    notes = []
    for c, w, words, note in ROLE_LABELS:
        hit = contains_any(label, words)
        bonus[c] = bonus[c] + F.when(hit, w).otherwise(0.0)
        notes.append(F.when(hit, F.lit(note)))
    d = d.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)) + bonus[c], 6) for c in CATEGORIES})
    five = [F.col(c) for c in CATEGORIES]
    who = role(F.col("games"), F.col("work"), F.col("media"), F.col("archive"), F.col("backup"))
    evidence = F.array_sort(F.array_distinct(F.concat(F.coalesce("_said", F.array().cast("array<string>")), F.array_compact(F.array(*notes)))))
    return d.withColumns({"role": who, "role_confidence": F.least(F.greatest(*five), F.lit(1.0)), "role_evidence": evidence}).withColumn(
        "target_role_eligibility", eligible_roles(F.col("role"))).drop("_said")
