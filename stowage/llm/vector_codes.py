"""Vector code compression: product codes of integer vectors, assigned by partial-distance search.

A vector is cut into parts, and each part becomes the number of the nearest entry of that part's codebook.  Codebooks are
fitted over all rows: each round assigns every part and replaces each entry by the floored mean of its parts.  A task
sends one row for each number of its sums, whatever it read, so a round ends with parts x entries x width numbers, which
Spark adds up and the driver divides.

The search goes through dimensions from the one in which a codebook varies most to the one in which it varies least, all
rows of a batch at once.  After each dimension the entry that is nearest so far is completed, for every row, and its
distance becomes the row's bound if it is smaller; entries whose distance so far is strictly above the bound are masked
for good.  All is done in 64-bit integers, so distances are exact and ties go to the lower entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, is_few, join_hot, python_side, scratched, sided, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that are searched at once.
ROWS = 2048


def edges(dim: int, parts: int = PARTS) -> list[int]:
    """Where parts begin and end: equal ones where parts divides dim, else as near as can be (some may be empty)."""
    return [dim * k // parts for k in range(parts + 1)]


def most(dim: int) -> int:
    """Integer components stop at plus and minus this, so that a distance of two vectors fits 62 bits: 2^27 for 64."""
    return 1 << ((61 - max(1, dim).bit_length()) // 2)


def integers(vectors: list, dim: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component."""
    x = np.array(vectors, dtype=np.float64).reshape(len(vectors), dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -most(dim), most(dim)).astype(np.int64)


def _nearest(row: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    """Of runs of equal row, the place of the first least entry of so_far in each."""
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.repeat(np.minimum.reduceat(so_far, start), np.diff(np.append(start, len(row))))
    at = np.flatnonzero(so_far == least)
    return at[np.append(True, row[at][1:] != row[at][:-1])]


def search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry of book, the lowest of equal ones, and its squared distance.  With no
    dimensions every distance is zero."""
    n, dim = x.shape
    if not n or not dim:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(-book.var(axis=0), kind="stable")
    row, entry = np.divmod(np.arange(n * len(book)), len(book))  # the entries that are left, by row and entry
    so_far = ((x[:, order[0], None] - book[None, :, order[0]]) ** 2).ravel()
    bound = np.full(n, np.iinfo(np.int64).max)
    for k in range(1, dim):
        near, rest = _nearest(row, so_far), order[k:]  # one place a row: the entry that gave the bound is never dropped
        bound = np.minimum(bound, so_far[near] + ((x[:, rest] - book[entry[near]][:, rest]) ** 2).sum(axis=1))
        on = so_far <= bound[row]  # dropped: strictly above the best complete distance
        row, entry, so_far = row[on], entry[on], so_far[on]
        so_far += (x[row, order[k]] - book[entry, order[k]]) ** 2
    best = _nearest(row, so_far)
    return entry[best], so_far[best]


def assign(x: np.ndarray, books: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and errors of integer vectors."""
    codes, error = np.zeros((len(x), len(cuts) - 1), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
    for lo in range(0, len(x), ROWS):
        some = x[lo:lo + ROWS]
        for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            codes[lo:lo + ROWS, part], d = search(some[:, a:b], books[:, a:b])
            error[lo:lo + ROWS] += d
    return codes, error


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, cuts: list[int], scale: int) -> Iterator[pa.RecordBatch]:
    """entry, place, total, n: what the task's parts add to each component of each entry."""
    total, n = np.zeros_like(books), np.zeros((len(books), len(cuts) - 1), dtype=np.int64)
    for batch in batches:
        x = integers(batch.column(0).to_pylist(), books.shape[1], scale)
        codes, _ = assign(x, books, cuts)
        for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            np.add.at(total[:, a:b], codes[:, part], x[:, a:b])
            n[:, part] += np.bincount(codes[:, part], minlength=len(books))
    count = np.repeat(n, np.diff(cuts), axis=1)
    entry, place = np.nonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (entry, place, total[entry, place], count[entry, place])], names=["entry", "place", "total", "n"])


class Codebooks:
    """entries x components; the columns of a part are its codebook."""

    def __init__(self, values: np.ndarray, parts: int = PARTS, scale: int = SCALE):
        self.values, self.cuts, self.scale = values, edges(values.shape[1], parts), scale

    @classmethod
    def fit(cls, good: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> Codebooks:
        """good: id, vec (doubles, dim each).  Starts at the vectors of the smallest ids (null ids last, ties by
        components); an entry that no part takes stays."""
        if not 1 <= entries <= 256:
            raise ValueError("a code is one byte")
        first = good.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
        books = integers([r["vec"] for r in first], dim, scale)
        cuts, spark = edges(dim, parts), good.sparkSession
        for _ in range(rounds):
            now = spark.sparkContext.broadcast(books)  # entries x dim numbers
            sums = good.select("vec").mapInArrow(lambda b, now=now: _sums(b, now.value, cuts, scale), "entry long, place long, total long, n long")
            sums = sums.groupBy("entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
            books = books.copy()
            for r in sums.collect():  # entries x dim rows at most
                books[r["entry"], r["place"]] = int(r["total"]) // r["n"]
        return cls(books, parts, scale)

    def encode(self, vectors: list) -> tuple[list[str], np.ndarray]:
        """Codes, two hex digits a part, and errors."""
        codes, error = assign(integers(vectors, self.values.shape[1], self.scale), self.values, self.cuts)
        text, wide = codes.tobytes().hex(), 2 * (len(self.cuts) - 1)
        return [text[k:k + wide] for k in range(0, wide * len(vectors), wide)], error

    def sha256(self) -> str:
        """Of all integer components by part, entry and position, comma-joined."""
        parts = [self.values[:, a:b].ravel() for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        return hashlib.sha256(",".join(map(str, np.concatenate(parts).tolist())).encode()).hexdigest()


@scratched
def _labelled(codes: DataFrame) -> DataFrame:
    """codes with label_error: the errors summed over rows of one label, nulls together.  Summed before the shuffle; a
    label with very many rows is not one task's work."""
    rows = written(codes.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(""))}), "codes")
    keys = ["_none", "_label"]
    sums = rows.groupBy(*keys).agg(F.try_sum("error").alias("label_error"))
    if is_few(sums := written(sums, "label_errors")):
        return rows.join(sided(sums, True), keys).drop(*keys)
    return join_hot(rows, sums, keys, hot_keys(rows, keys)).drop(*keys)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES,
                 rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(codes, codebooks): a row for each vector that is not null and holds no null or non-finite component: id, label
    (as text), code, error and label_error; and the fitted codebooks, None if there are no such rows.

    Codebooks have one length: the one that most kept vectors have, the smaller of equal ones; vectors of another length
    stay with null code and error.  Components stop at most(length), 2^19 as a double for 64.  Repeated rows and ids
    repeat and count each; a null id stays null and comes last among the first entries; null labels are one label, and
    a sum that no long holds is null.  With fewer vectors than entries the codebooks are smaller.  Other columns are not
    looked at.  The input is scanned once a round and twice more, so it should be a table."""
    spark = vectors.sparkSession
    python_side(spark)
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    rows = rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    books = None
    if lengths:
        dim = lengths[0]["dim"]
        books = Codebooks.fit(rows.where(F.size("vec") == dim).select("id", "vec"), dim, entries, rounds, parts, scale)
    model = spark.sparkContext.broadcast(books)

    def work(batches):
        for batch in batches:
            vecs = batch.column(2).to_pylist()
            fit = [k for k, v in enumerate(vecs) if len(v) == model.value.values.shape[1]]
            codes, errors = [None] * len(vecs), [None] * len(vecs)
            text, error = model.value.encode([vecs[k] for k in fit])
            for k, c, e in zip(fit, text, error.tolist(), strict=True):
                codes[k], errors[k] = c, e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    out = _labelled(rows.mapInArrow(work, "id long, label string, code string, error long"))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    out, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def _assigned(name: str, books: str) -> str:
    """SQL: each part's nearest entry; d is its squared distance."""
    return f"""
{name}_d AS (
  SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM comps p JOIN {books} b ON b.part = p.part AND b.pos = p.pos GROUP BY ALL),
{name} AS (SELECT * FROM {name}_d QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""


def _replaced(name: str, codes: str, books: str) -> str:
    """SQL: each entry's floored mean, or the entry itself."""
    return f"""
{name}_s AS (
  SELECT c.part, c.entry, p.pos, sum(p.x)::BIGINT AS total, count(*) AS n FROM {codes} c JOIN comps p ON p.vec_id = c.vec_id AND p.part = c.part GROUP BY ALL),
{name} AS (
  SELECT b.part, b.entry, b.pos, CASE WHEN s.n IS NULL THEN b.x WHEN s.total % s.n < 0 THEN s.total // s.n - 1 ELSE s.total // s.n END AS x
  FROM {books} b LEFT JOIN {name}_s s ON s.part = b.part AND s.entry = b.entry AND s.pos = b.pos)"""


OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps_ AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS place, len(e) // 16 AS wide FROM v),
comps AS (SELECT vec_id, place // wide AS part, place % wide AS pos, x FROM comps_),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64),
b0 AS (SELECT c.part, f.entry, c.pos, c.x FROM comps c JOIN first f ON f.vec_id = c.vec_id),{_assigned("a1", "b0")},{_replaced("b1", "a1", "b0")},{_assigned("a2", "b1")},{_replaced("b2", "a2", "b1")},{_assigned("a3", "b2")},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2),
sums AS (SELECT v.label, sum(c.error)::BIGINT AS label_error FROM v JOIN codes c ON c.vec_id = v.vec_id GROUP BY v.label)
SELECT v.vec_id, c.code, c.error, s.label_error, sha.codebooks_sha256
FROM v JOIN codes c ON c.vec_id = v.vec_id JOIN sums s ON s.label IS NOT DISTINCT FROM v.label CROSS JOIN sha
"""
