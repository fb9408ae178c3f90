"""License scan: ordered signature rules over normalised words, with a keyword gate.

A text becomes words (letters and digits, A-Z lower-cased; everything else in ASCII divides) joined by one space.  The
set of its words meets the set of all keywords once, and only rules with a keyword in it are searched, in the whole text.
Detections are settled in the order of their rules: one that lies within a detection that was kept before is dropped
(a name within a grant, a family within a version); overlaps without containment both stay.  The base phrases are kept
whatever holds them, and drop nothing themselves.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, python_side
from .license_rules import Rule, rules

DETECTION = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("priority", pa.int32()), ("base", pa.bool_())])
DETECTION_SQL = "struct<label:string,start:long,stop:long,priority:int,base:boolean>"
_PLAIN = bytes.maketrans(UPPER.encode(), LOWER.encode())
_DIVIDES = bytes(c for c in range(128) if not chr(c).isalnum())
_TABLE = bytes(32 if c in _DIVIDES else _PLAIN[c] for c in range(256))


class Scanner:
    """Rules by keyword.  Rules are tried in their order: base phrases, then by falling priority."""

    def __init__(self, some: list[Rule] | None = None):
        self.rules = rules() if some is None else some
        self.by_word: dict[bytes, list[int]] = {}
        for k, r in enumerate(self.rules):
            for word in r.keywords:
                self.by_word.setdefault(word.encode(), []).append(k)
        self.words = frozenset(self.by_word)

    def gated(self, words: list[bytes]) -> list[int]:
        """Numbers of the rules with a keyword among words."""
        return sorted({k for w in self.words.intersection(words) for k in self.by_word[w]})

    def scan(self, text: str | None, gate: bool = True) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of words, and the kept detections (rule, first word, word after the last) by place.  gate: whether
        keywords decide which rules are tried; the result is the same."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        tried = self.gated(words) if gate else range(len(self.rules))
        if not tried or not words:
            return len(words), []
        plain = b" ".join(words)
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        kept: list[tuple[int, int, int]] = []
        cover = Cover()
        at = 0
        tried = list(tried)
        while at < len(tried):
            level = self.rules[tried[at]].priority
            found = []
            while at < len(tried) and self.rules[tried[at]].priority == level:
                for m in self.rules[tried[at]].pattern.finditer(plain):
                    found.append((m.start() - m.end(), tried[at], m.start(), m.end()))
                at += 1
            for _, rule, a, b in sorted(found):  # of one priority the longer first, then by the order of the rules
                if self.rules[rule].base:
                    kept.append((rule, a, b))
                elif not cover.holds(a, b):
                    cover.add(a, b)
                    kept.append((rule, a, b))
        place = lambda x: int(np.searchsorted(starts, x, "right"))
        return len(words), sorted(((k, place(a) - 1, place(b - 1)) for k, a, b in kept), key=lambda d: (d[1], d[2], d[0]))

    def score(self, found: list[tuple[int, int, int]]) -> float:
        """How sure it is that the text states a license: 1 minus the product of what each label leaves open."""
        best: dict[str, float] = {}
        for k, _, _ in found:
            r = self.rules[k]
            best[r.label] = max(best.get(r.label, 0.0), r.strength)
        left = 1.0
        for label in sorted(best):
            left *= 1 - best[label]
        return 1 - left


class Cover:
    """Intervals, asked whether one of them holds another; kept as those that no other holds, by start and so by end."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.ends[k] >= b

    def add(self, a: int, b: int) -> None:
        lo, hi = bisect_left(self.starts, a), bisect_right(self.ends, b)
        self.starts[lo:max(lo, hi)], self.ends[lo:max(lo, hi)] = [a], [b]


@cache
def scanner() -> Scanner:
    return Scanner()


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, detections (array of label, start, stop, priority, base: words from
    start up to stop, by place) and score (0 without detections, to 1).  Null, empty and blank texts have no words and no
    detections; whole texts are read, however long; repeated rows repeat; a null id stays null; other columns are not
    looked at; no rows give no rows."""
    python_side(docs.sparkSession)

    def work(batches):
        s = scanner()
        for batch in batches:
            rows = [s.scan(t) for t in batch.column(1).to_pylist()]
            said = [[{"label": s.rules[k].label, "start": a, "stop": b, "priority": s.rules[k].priority, "base": s.rules[k].base} for k, a, b in found] for _, found in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array(said, pa.list_(DETECTION)), pa.array([s.score(f) for _, f in rows], pa.float64())],
                names=[id_col, "n_words", "detections", "score"])

    two = docs.selectExpr(f"cast(`{id_col}` as bigint) as `{id_col}`", f"`{text_col}` as _text")
    return two.mapInArrow(work, f"`{id_col}` long, n_words long, detections array<{DETECTION_SQL}>, score double")


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    rows = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.expr("filter(detections, d -> d.base)")
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(c["label"])), ",")
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["start"]).alias("first_word"),
                       F.array_max(base["start"]).alias("last_word"), said(base).alias("base_labels"), said(F.col("detections")).alias("labels"), "score")
