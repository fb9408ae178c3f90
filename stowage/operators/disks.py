"""Disk enrichment: one chain of column expressions over the probed disks, hints from the platform first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_any, interface, mount_key, optional

# Fixed values.
CLOUD_WORDS = ("google drive", "googledrive", "drivefs", "onedrive", "dropbox", "icloud", "box", "pcloud", "sync.com", "mega", "webdav")
NETWORK_FS = ("nfs", "cifs", "smb", "afp", "fuse.sshfs", "davfs", "webdav", "sshfs")
VIRTUAL_NAMES = ("virtual", "subst", "imdisk", "ramdisk")
VIRTUAL_FS = ("tmpfs", "overlay", "proc", "sysfs", "devfs", "fuse.portal", "ramfs")
LOCAL_SNAPSHOTS = "/volumes/com.apple.time-machine.localsnapshots"
VENDORS = (("samsung", "Samsung"), ("seagate", "Seagate"), ("western digital", "Western Digital"), ("wd ", "Western Digital"), ("toshiba", "Toshiba"),
           ("kingston", "Kingston"), ("sandisk", "SanDisk"), ("crucial", "Crucial"), ("intel", "Intel"), ("hynix", "SK hynix"), ("micron", "Micron"))
#: class and confidence by storage type
PERFORMANCE = {"nvme": ("fast", 0.9), "ssd": ("fast", 0.8), "hdd": ("slow", 0.75), "usb": ("balanced", 0.55), "network": ("slow", 0.65),
               "cloud_backed": ("slow", 0.65), "virtual": ("unknown", 0.45)}
LOCALITY = {"cloud_backed": 0.95, "network": 0.9, "local_virtual": 0.8, "local_physical": 0.7, "unknown": 0.4}
RANK = {"fast": 3.0, "balanced": 2.0, "slow": 1.0, "unknown": 0.5}
BONUS = {"nvme": 0.5, "ssd": 0.3, "hdd": 0.0, "usb": -0.1, "cloud_backed": -0.3, "network": -0.3, "virtual": -0.2, "unknown": -0.2}


def lookup(c: Column, table: dict, default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def locality(name: Column, mount: Column, fs: Column) -> Column:
    n, m, f = low(name), low(mount), low(fs)
    label = n.contains("@") & (n.contains("googl") | n.contains("drive"))
    cloud = label | contains_any(n, CLOUD_WORDS) | contains_any(m, CLOUD_WORDS) | contains_any(f, CLOUD_WORDS)
    network = F.startswith(m, F.lit("\\\\")) | F.startswith(m, F.lit("//")) | contains_any(f, NETWORK_FS)
    virtual = contains_any(n, VIRTUAL_NAMES) | m.contains(LOCAL_SNAPSHOTS) | contains_any(f, VIRTUAL_FS)
    return F.when(cloud, "cloud_backed").when(network, "network").when(virtual, "local_virtual").when(m != "", "local_physical").otherwise("unknown")


def storage_type(kind: Column, place: Column, name: Column, bus: Column, removable: Column) -> Column:
    n, b = low(name), F.coalesce(bus, F.lit(""))
    return (F.when(place == "cloud_backed", "cloud_backed").when(place == "network", "network").when(place == "local_virtual", "virtual")
            .when(n.contains("nvme") | (b == "nvme"), "nvme").when(removable | (b == "usb") | n.contains("usb"), "usb")
            .when(kind.isin("ssd", "hdd"), kind).otherwise("unknown"))


def performance_rank(klass: Column, kind: Column, confidence: Column) -> Column:
    return lookup(klass, RANK, 0.5) + lookup(kind, BONUS, -0.2) + 0.2 * confidence


def enrich(probes: DataFrame, hints: DataFrame | None = None, os_mount: str = "/") -> DataFrame:
    """probes: scan_id, pos, name, mount_point, total_space_bytes, free_space_bytes, disk_kind, file_system, is_removable.
    hints: pos, mount_point, vendor, model, interface, rotational, confidence, source (rows of one mount are merged).
    Returns the disks table, by mount point within each scan; as many rows as there are probes."""
    d = probes.withColumn("_m", mount_key(F.col("mount_point")))
    if hints is None:
        d = d.withColumns({c: F.lit(None).cast(t) for c, t in (("_v", "string"), ("_mo", "string"), ("_i", "string"), ("_r", "boolean"), ("_s", "string"))})
    else:
        one = merge_hints(hints.withColumn("mount_point", mount_key(F.col("mount_point"))))
        h = one.select(F.col("mount_point").alias("_m"), optional(F.col("vendor")).alias("_v"), optional(F.col("model")).alias("_mo"),
                         interface(F.col("interface")).alias("_i"), F.col("rotational").alias("_r"), F.col("source").alias("_s"))
        d = d.join(h, "_m", "left")
    name, fs = low(F.col("name")), low(F.col("file_system"))
    m = low(F.col("mount_point"))
    removable = F.coalesce("is_removable", F.lit(False))
    network = F.startswith(m, F.lit("\\\\")) | F.startswith(m, F.lit("//")) | contains_any(fs, NETWORK_FS)
    bus = F.when(name.contains("nvme") | fs.contains("nvme"), "nvme").when(removable | name.contains("usb"), "usb").when(network, "network")
    vendor = None
    for word, label in VENDORS:
        vendor = F.when(name.contains(word), label) if vendor is None else vendor.when(name.contains(word), label)
    hybrid = contains_any(name, ("sshd", "hybrid"))
    d = d.withColumns({
        "locality_class": locality(F.col("name"), F.col("mount_point"), F.col("file_system")),
        "interface": F.coalesce("_i", bus), "vendor": F.coalesce("_v", vendor), "model": F.coalesce("_mo", optional(F.col("name"))),
        "_spin": F.coalesce("_r", F.when(F.col("disk_kind") == "hdd", True).when(F.col("disk_kind") == "ssd", False)),
        "hybrid": F.when(F.col("disk_kind").isin("hdd", "ssd") | hybrid, hybrid),
    })
    kind = storage_type(F.col("disk_kind"), F.col("locality_class"), F.col("name"), F.col("interface"), removable)
    d = d.withColumn("storage_type", F.when((kind == "unknown") & F.col("_r").isNotNull(), F.when(F.col("_r"), "hdd").otherwise("ssd")).otherwise(kind))
    physical = (F.col("storage_type") == "unknown") & (F.col("locality_class") == "local_physical")
    d = d.withColumns({
        "locality_confidence": lookup(F.col("locality_class"), LOCALITY),
        "performance_class": F.when(physical, "balanced").otherwise(lookup(F.col("storage_type"), {k: v[0] for k, v in PERFORMANCE.items()}, "unknown")),
        "performance_confidence": F.when(physical, 0.4).otherwise(lookup(F.col("storage_type"), {k: v[1] for k, v in PERFORMANCE.items()}, 0.35)),
        "is_os_drive": F.col("_m") == mount_key(F.lit(os_mount)),
    })
    reasons = F.array_compact(F.array(
        F.when(F.col("is_os_drive"), "holds the operating system"),
        F.when(F.col("locality_class") != "local_physical", F.concat(F.lit("locality is "), F.col("locality_class"))),
        F.when(F.col("storage_type").isin("cloud_backed", "network", "virtual"), "storage is not local")))
    return d.withColumns({
        "rotational": F.col("_spin"), "ineligible_reasons": reasons, "eligible_for_local_target": F.size(reasons) == 0,
        "metadata_notes": F.array_compact(F.array(F.concat(F.lit("hints from "), F.col("_s")))),
        "performance_rank": performance_rank(F.col("performance_class"), F.col("storage_type"), F.col("performance_confidence")),
        "used_bytes": F.greatest(F.col("total_space_bytes") - F.col("free_space_bytes"), F.lit(0)),
    }).drop("_m", "_v", "_mo", "_i", "_r", "_s", "_spin")


def merge_hints(hints: DataFrame) -> DataFrame:
    """One row a mount from several hint rows (mount_point, pos, vendor, model, interface, rotational, confidence,
    source): the most confident row counts, gaps are filled from the next ones."""
    if "pos" not in hints.columns:
        hints = hints.withColumn("pos", F.lit(0))
    order = F.struct((-F.col("confidence")).alias("c"), F.col("pos"))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), "vendor", "model", "interface", "rotational", "confidence", "source")))
    first = lambda f: F.get(F.filter(F.col("_r"), lambda r: r[f].isNotNull()), F.lit(0))[f].alias(f)
    return hints.groupBy("mount_point").agg(rows.alias("_r")).select("mount_point", *(first(f) for f in ("vendor", "model", "interface", "rotational", "confidence", "source")))
