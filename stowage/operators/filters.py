"""Excludes, and the predicates of the report views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GLOB = re.compile(r"[*?\[\]{}]")
_BEGIN, _END = r"(?s)\A", r"\z"


class BadGlob(ValueError):
    pass


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: * and ? cross slashes, **/ is any number of directories, {a,b} and [!x] as usual."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise BadGlob(pattern)
            body = pattern[i + 1:end]
            no = body[:1] in ("!", "^")
            body = body[1:] if no else body
            out.append("[" + "^" * no + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "}" or c == "]":
            raise BadGlob(pattern)
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise BadGlob(pattern)
    return _BEGIN + "".join(out) + _END


def trie_regex(words) -> str:
    """One expression that matches where any of the words stands: a trie, so at each place of a text only the letters that
    go on are tried, however many words there are."""
    root: dict = {}
    for w in words:
        at = root
        for c in w:
            at = at.setdefault(c, {})
            if "" in at:
                break  # a shorter word ends here: whatever follows, it matches
        else:
            at.clear()
            at[""] = {}

    def said(node: dict) -> str:
        out = ""
        while len(node) == 1 and "" not in node:
            (c, node), = node.items()
            out += re.escape(c)
        if "" in node:
            return out
        leaves = sorted(c for c, below in node.items() if "" in below)
        parts = ["[" + "".join("\\" + c if c in "\\]^-[&~|" else c for c in leaves) + "]"] if leaves else []
        parts += [re.escape(c) + said(below) for c, below in sorted(node.items()) if "" not in below]
        return out + (parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")")

    return said(root)


class Excludes:
    """Compiled on the driver: patterns with a glob character become regular expressions on the whole path, others
    lower-cased substrings.  A glob that can't be read is a warning and a substring.

    All substrings are one trie expression, and all globs one alternation.  A directory above a path is a prefix of it, so
    a substring of the one is a substring of the other: substrings are looked for in the path alone, once.  Globs, which
    hold for whole paths, are tried once on each component of the path below the root."""

    def __init__(self, patterns):
        self.globs: list[str] = []
        self.words: list[str] = []
        self.warnings: list[str] = []
        for p in (x.strip() for x in patterns):
            if not p:
                continue
            if not _GLOB.search(p):
                self.words.append(p.lower())
                continue
            try:
                self.globs.append(glob_regex(p))
            except BadGlob:
                self.warnings.append(f"exclude pattern {p!r} is no glob; it is taken as text")
                self.words.append(p.lower())
        bare = [g.removeprefix(_BEGIN).removesuffix(_END) for g in dict.fromkeys(self.globs)]
        self.any_word = trie_regex(self.words) if self.words else None
        self.any_glob = f"{_BEGIN}(?:{'|'.join(bare)}){_END}" if bare else None
        self._word = None if self.any_word is None else re.compile(self.any_word)
        self._glob = None if self.any_glob is None else re.compile(self.any_glob.removesuffix(_END) + r"\Z")

    def hits(self, path: Column) -> Column:
        out = F.lit(False)
        if self.any_glob is not None:
            out = out | path.rlike(self.any_glob)
        if self.any_word is not None:
            out = out | F.lower(path).rlike(self.any_word)
        return out

    def matches(self, path: str) -> bool:
        """The same for one path, for walkers."""
        return bool((self._glob and self._glob.search(path)) or (self._word and self._word.search(path.lower())))

    def prune(self, files: DataFrame, path_col: str = "path", root_col: str = "root_path") -> DataFrame:
        """files without those that are excluded or stand below an excluded directory; the root itself never is."""
        if not (self.globs or self.words):
            return files
        from ..functions.scalars import ancestors

        base = F.length(F.rtrim(F.col(root_col), F.lit("/")))
        out = F.lit(False)
        if self.any_word is not None:  # the path as ancestors() has it, the longest of them
            whole = F.rtrim(F.translate(path_col, "\\", "/"), F.lit("/"))
            out = out | ((F.length(whole) > base) & F.lower(whole).rlike(self.any_word))
        if self.any_glob is not None:
            out = out | F.exists(F.filter(ancestors(F.col(path_col)), lambda p: F.length(p) > base), lambda p: p.rlike(self.any_glob))
        return files.where(~out)


def contains_text(c: Column, query: str) -> Column:
    q = query.strip().lower()
    return F.lit(True) if not q else F.coalesce(F.lower(c).contains(q), F.lit(False))


def search_usage(paths: DataFrame, query: str) -> DataFrame:
    return paths.where(contains_text(F.col("root_path"), query))


def search_duplicates(groups: DataFrame, query: str, children: DataFrame | None = None) -> DataFrame:
    """By intent label, hash or any file path: of the files beside the group, or of all in the child table."""
    named = contains_text(F.col("intent"), query) | contains_text(F.col("hash"), query)
    if children is None:
        return groups.where(named | F.exists("files", lambda f: contains_text(f["path"], query)))
    hit = children.where(contains_text(F.col("path"), query)).select("scan_id", "size_bytes", "hash").distinct().withColumn("_hit", F.lit(True))
    return groups.join(hit, ["scan_id", "size_bytes", "hash"], "left").where(named | F.col("_hit")).drop("_hit")


def filter_recommendations(recs: DataFrame, query: str = "", policy: str = "all", kind: str = "all") -> DataFrame:
    """policy: all, safe or blocked; kind: an evidence kind, or all."""
    out = recs.where(contains_text(F.col("title"), query) | contains_text(F.col("rationale"), query) | contains_text(F.col("id"), query))
    if policy != "all":
        out = out.where(F.col("policy_safe") == (policy == "safe"))
    return out if kind == "all" else out.where(F.exists("evidence", lambda e: e["kind"] == kind))


def filter_traces(traces: DataFrame, status: str = "all", recommendation_id: str = "all") -> DataFrame:
    out = traces if status == "all" else traces.where(F.col("status") == status)
    return out if recommendation_id == "all" else out.where(F.col("recommendation_id") == recommendation_id)


def trace_status_counts(traces: DataFrame) -> DataFrame:
    """Traces by status, and all of them."""
    return traces.rollup("status").agg(F.count(F.lit(1)).alias("traces")).withColumn("status", F.coalesce("status", F.lit("all")))


def permission_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("scan_id").agg(F.count_if(F.lower("text").contains("permission")).alias("permission_denied_warnings"), F.count(F.lit(1)).alias("warnings"))


def validate_options(min_ratio: float | None = None, progress_interval_ms: int = 250, cache: bool = False, ttl_seconds: int = 900) -> None:
    if min_ratio is not None and not 0.0 <= min_ratio <= 1.0:
        raise ValueError("min_ratio must lie between 0 and 1")
    if progress_interval_ms <= 0:
        raise ValueError("progress_interval_ms must be above 0")
    if cache and ttl_seconds <= 0:
        raise ValueError("ttl_seconds must be above 0 with the cache on")
