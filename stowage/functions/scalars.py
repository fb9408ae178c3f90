"""Scalar functions, all built from Spark SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 10^0 .. of 1024, largest first, for human_bytes.
_UNITS = (("TB", 1 << 40), ("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10))


def contains_any(c: Column, words) -> Column:
    """Whether any of the words stands in c (false for null)."""
    return F.coalesce(c.rlike("|".join(re.escape(w) for w in words)), F.lit(False)) if words else F.lit(False)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; "none" without one or for a name that only begins with it."""
    name = basename(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.lower(F.substring_index(name, ".", -1))).otherwise("none")


def relative(path: Column, root: Column) -> Column:
    """path below root, without a leading slash; null if it is not below it."""
    base = F.when(root == "/", F.lit("/")).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1))


def top_directory(path: Column, root: Column) -> Column:
    """The first-level directory that a file stands in; null for a file directly in the root."""
    rel = relative(path, root)
    base = F.when(root == "/", F.lit("/")).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
    return F.when(F.locate("/", rel) > 0, F.concat(base, F.substring_index(rel, "/", 1)))


def ancestors(path: Column) -> Column:
    """The path and every directory above it, both separators taken as one."""
    parts = F.split(F.rtrim(F.translate(path, "\\", "/"), F.lit("/")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.transform(up, lambda p: F.when(p == "", "/").otherwise(p))


def parent_directory(path: Column) -> Column:
    """The directory that the path stands in; / above the first level."""
    p = F.regexp_replace(F.rtrim(F.translate(path, "\\", "/"), F.lit("/")), "/[^/]*$", "")
    return F.when(p == "", "/").otherwise(p)


def path_depth(path: Column) -> Column:
    """Separators above the last component: 0 for / and a bare drive."""
    p = F.rtrim(F.translate(path, "\\", "/"), F.lit("/"))
    return (F.length(p) - F.length(F.translate(p, "/", ""))).cast("int")


def path_suffix(path: Column, n: int = 2) -> Column:
    """The last n components, lower-cased, last first."""
    parts = F.filter(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda p: p != "")
    return F.slice(F.reverse(parts), 1, n)


def dashed_id(c: Column) -> Column:
    """Each character that is no ASCII letter or digit becomes a dash."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "-")


def bare_id(c: Column) -> Column:
    """Characters that are no ASCII letter or digit go."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def human_bytes(c: Column) -> Column:
    """One decimal, exact halves to the even one."""
    out = F.when(c == 0, F.lit("0 B"))
    for unit, size in _UNITS:
        out = out.when(c >= size, F.format_string(f"%.1f {unit}", F.bround(c / size, 1)))
    return out.otherwise(F.format_string("%.1f B", c.cast("double")))


def display_bytes(c: Column) -> Column:
    """n/a for null or nothing; no decimals from 100 on, or for bytes; exact halves go up."""
    out = F.when(c.isNull() | (c <= 0), "n/a")
    for unit, size in _UNITS:
        v = c / size
        out = out.when(c >= size, F.when(v >= 100, F.format_string(f"%.0f {unit}", v)).otherwise(F.format_string(f"%.1f {unit}", v)))
    return out.otherwise(F.format_string("%.0f B", c.cast("double")))


def display_confidence(c: Column) -> Column:
    return F.format_string("%.1f%%", c.cast("double") * 100)


def display_signed_bytes(c: Column) -> Column:
    return F.when(c == 0, "0 B").otherwise(F.concat(F.when(c > 0, "+").otherwise("-"), display_bytes(F.abs(c))))


def human_days(days: Column) -> Column:
    return F.when(days <= 1, "day").otherwise(F.concat(days.cast("string"), F.lit(" days")))


def windows_mount(c: Column) -> Column:
    """Backslashes, a drive letter in upper case, X: as X:\\."""
    s = F.translate(F.trim(c), "/", "\\")
    s = F.when(s.rlike(r"^.:$"), F.concat(s, F.lit("\\"))).otherwise(s)
    return F.when(s.rlike(r"^.:"), F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))).otherwise(s)


def unix_mount(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s == "/", s).otherwise(F.rtrim(s, F.lit("/")))


def mount_key(c: Column) -> Column:
    """The form in which mounts of either kind are compared."""
    windows = F.trim(c).rlike(r"^[A-Za-z]:([\\/]|$)") | F.startswith(F.trim(c), F.lit("\\\\"))
    return F.when(windows, windows_mount(c)).otherwise(unix_mount(c))


def optional(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def interface(c: Column) -> Column:
    """A raw bus name as nvme, usb, sata, virtio or network; in this order (so iscsi, which holds scsi, is sata)."""
    low = F.lower(optional(c))
    return (F.when(low.contains("nvme"), "nvme").when(low.contains("usb"), "usb").when(contains_any(low, ("sata", "ata", "sas", "scsi", "pcie")), "sata")
            .when(low.contains("virtio"), "virtio").when(contains_any(low, ("network", "iscsi", "nfs", "smb")), "network"))


def rotational(c: Column) -> Column:
    """true, false or null from the text of a boolean, number or word."""
    low = F.lower(F.trim(c.cast("string")))
    number = low.try_cast("double")
    return F.when(low.isin("true", "yes"), True).when(low.isin("false", "no"), False).when(number.isNotNull(), number != 0)


def media_rotational(c: Column) -> Column:
    low = F.lower(c)
    return F.when(contains_any(low, ("ssd", "solid state")), False).when(contains_any(low, ("hdd", "hard disk")), True)


def signed_delta(left: Column, right: Column) -> Column:
    return F.coalesce(right, F.lit(0)) - F.coalesce(left, F.lit(0))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_time(text: Column) -> Column:
    """null where it can't be read."""
    return F.try_to_timestamp(text)


def escape_lines(c: Column) -> Column:
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_stem(scan_id: Column, prefix: str = "scan-") -> Column:
    """A file stem: the id itself if it is plain and can't be mistaken for a digest, else prefix and digest."""
    plain = scan_id.rlike(r"\A[A-Za-z0-9_-]+\z") & ~F.startswith(scan_id, F.lit(prefix))
    return F.when(plain, scan_id).otherwise(F.concat(F.lit(prefix), F.sha2(scan_id, 256)))


def cache_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def throughput_mb_s(bytes_: Column, ms: Column) -> Column:
    return F.when(ms > 0, bytes_ / 1048576 / (ms / 1000)).otherwise(F.lit(0.0))


def cache_age_seconds(now: Column, created: Column) -> Column:
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(created), F.lit(0))


def clamped_confidence(score: Column) -> Column:
    return F.least(0.65 + 0.1 * score, F.lit(0.92))


def used_space(total: Column, free: Column) -> Column:
    return F.greatest(total - free, F.lit(0))
