"""Periodic run detection: every maximal stretch of words that repeats with some period.

By the runs theorem the root of a run is, somewhere in it, the longest Lyndon word that starts at its place, under one of
two orders of the suffixes, each the reverse of the other.  That word ends at the next smaller suffix, which is the next
smaller value of the inverse suffix array.  Each such root (i, j) whose first word stands at j again is extended to the
right by one longest common extension of i and j, and to the left by halving: i and j can go t words back if the
extension from there is at least t.  Extensions are minima of the LCP array, from a sparse table.

Texts are worked in blocks of about BLOCK words.  The letters of a text are numbers of their own, so the suffixes of a
text stand together in the order, and copies of a text in one block cost no more than other texts.  The end of a text is
a letter smaller than its others.  Memory is about 100 bytes a word of a block and twelve more for each doubling; a
longer text is a block by itself, read whole.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_side

MIN_LENGTH, MIN_EXPONENT = 6, 4
BLOCK = 100_000
#: Places looked at one by one for a next smaller value, before the table of minima takes over.
STEPS = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Minima:
    """Minima of ranges of v, from the minima of all ranges of 1, 2, 4, ... places."""

    def __init__(self, v: np.ndarray):
        self.rows, k = [v], 1
        while 2 * k <= len(v):
            self.rows.append(np.minimum(self.rows[-1][:-k], self.rows[-1][k:]))
            k *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of v[lo:hi], for each pair of places; no range is empty."""
        out = np.empty(len(lo), dtype=self.rows[0].dtype)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out

    def after(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each place the first one, itself included, that holds less than the value; there must be one."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            held = np.flatnonzero(at < len(row))
            on = held[row[at[held]] > value[held]]
            at[on] += 1 << k
        return at


def suffix_array(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the LCP array (entry r: of the suffixes at r - 1 and r).  By prefix doubling, where
    only suffixes that still share their rank are sorted again.  Each text ends with a letter that occurs once."""
    n = len(letters)
    sa = np.argsort(letters, kind="stable")
    head = np.append(True, letters[sa[1:]] != letters[sa[:-1]])
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ranks, split, k = [rank.copy()], np.zeros(n, dtype=np.int64), 1
    at = np.flatnonzero(~head | ~np.append(head[1:], True))
    while len(at):
        s = sa[at]
        key = rank[s].astype(np.int64) * n + rank[s + k]
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[at] = s
        first = np.append(True, key[1:] != key[:-1])
        rank[s] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        new = at[first]
        new = new[~head[new]]
        head[new], split[new] = True, len(ranks)
        ranks.append(rank.copy())
        at = at[~first | ~np.append(first[1:], True)]
        k *= 2
    # suffixes that parted in round t share 2^(t-1) letters and not 2^t; earlier rounds' ranks give the rest bit by bit
    lcp = np.where(split > 0, 1 << np.maximum(split - 1, 0), 0)
    for t in range(len(ranks) - 3, -1, -1):
        on = np.flatnonzero(split - 1 > t)
        lcp[on[ranks[t][sa[on - 1] + lcp[on]] == ranks[t][sa[on] + lcp[on]]]] += 1 << t
    return sa, rank, lcp.astype(np.int32)


def next_smaller(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of starts the next place that holds less; there must be one."""
    at, own = starts + 1, v[starts]
    on = np.arange(len(starts))
    for _ in range(STEPS):
        on = on[v[at[on]] > own[on]]
        at[on] += 1
    if len(on):
        at[on] = Minima(v).after(at[on], own[on])
    return at


def find_runs(texts: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of all maximal runs of texts, given as arrays of word numbers from 0, that have
    at least min_length words and min_exponent (at least 2) periods; sorted."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return np.zeros((0, 4), dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    first = ends - sizes
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    letters = np.concatenate([x for t in texts for x in (t, [-1])]).astype(np.int64) + 1
    letters += text * (letters.max() + 1)
    inner = np.ones(len(letters), dtype=bool)
    inner[ends] = False
    inner = np.flatnonzero(inner)
    _, rank, lcp = suffix_array(letters)
    other = -rank
    other[ends] = -len(letters) - 1  # under the reversed order too a word stops at the end of its text
    i, j = np.concatenate([np.stack((inner, next_smaller(v, inner))) for v in (rank, other)], axis=1)
    again = letters[i] == letters[j]
    i, j = i[again], j[again]
    minima = Minima(lcp)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = rank[a], rank[b]
        return minima.of(np.minimum(a, b) + 1, np.maximum(a, b) + 1)

    p, right = j - i, common(i, j)
    # the first root of a run starts among its first p words, so this much must follow j
    enough = right >= np.maximum((min_exponent - 2) * p, min_length - 2 * p) + 1
    i, j, p, end = i[enough], j[enough], p[enough], (j + right)[enough]
    one = np.unique(end * (len(letters) + 1) + p, return_index=True)[1]  # roots of one run share its end and period
    i, j, p, end = i[one], j[one], p[one], end[one]
    low, high = np.zeros_like(i), i - first[text[i]]
    while (on := np.flatnonzero(low < high)).size:
        mid = (low[on] + high[on] + 1) // 2
        back = common(i[on] - mid, j[on] - mid) >= mid
        low[on[back]] = mid[back]
        high[on[~back]] = mid[~back] - 1
    start = i - low
    length = end - start
    long = (length >= min_length) & (length >= min_exponent * p)
    out = np.stack((text[start], start - first[text[start]], length, p), axis=1)[long]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _blocks(texts: list[str | None]):
    """Lists of texts' words, of about BLOCK words together."""
    block, size = [], 0
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()  # of bytes: at space, \t, \n, \v, \f and \r alone
        if block and size + len(words) > BLOCK:
            yield block
            block, size = [], 0
        block.append(words)
        size += len(words)
    yield block


def collapse(texts: list[str | None], min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> list[tuple[int, list, str]]:
    """For each text its number of words, its runs (start, length, period), and its words, joined by one space, without
    those that repeat words of a run: all of a run after its first period."""
    out = []
    for block in _blocks(texts):
        number: dict[bytes, int] = {}
        runs = find_runs([np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) for words in block], min_length, min_exponent)
        cuts = np.searchsorted(runs[:, 0], np.arange(len(block) + 1))
        for d, words in enumerate(block):
            mine = runs[cuts[d]:cuts[d + 1], 1:]
            kept = words
            if len(mine):
                over = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(over, mine[:, 0] + mine[:, 2], 1)
                np.add.at(over, mine[:, 0] + mine[:, 1], -1)
                kept = compress(words, (np.cumsum(over)[:-1] == 0).tolist())
            out.append((len(words), mine.tolist(), b" ".join(kept).decode("utf-8", "surrogatepass")))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: float = MIN_EXPONENT) -> DataFrame:
    """One row for each row of docs: id, n_words, runs (array of start, length, period, sorted by start and period) and
    kept_text.  A run is a stretch of words with smallest period p that no neighbouring word extends, of at least
    min_length words and min_exponent (at least 2) times p.  Words are divided by ASCII white space; kept_text joins by
    one space the words that no run holds after its first period.  Null, empty and blank texts have no words, no runs and
    the empty kept_text; a null id stays null; repeated rows repeat; other columns are not looked at; no rows give no
    rows."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    python_side(docs.sparkSession)

    def work(batches):
        for batch in batches:
            rows = collapse(batch.column(1).to_pylist(), min_length, min_exponent)
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in rows], pa.list_(RUN))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), runs, pa.array([r[2] for r in rows], pa.string())],
                                             names=[id_col, "n_words", "runs", "kept_text"])

    two = docs.selectExpr(f"cast(`{id_col}` as bigint) as `{id_col}`", f"`{text_col}` as _text")
    return two.mapInArrow(work, f"`{id_col}` long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of the contract's documents: where crc32 of the decimal id divides by 10, the words from one on
    repeat with a period that the same number gives.  A null id plants nothing."""
    rows = docs.selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) as h")
    rows = rows.selectExpr("doc_id", "text", "h", "if(h % 10 = 0, filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != ''), null) as w")
    rows = rows.selectExpr("*", "size(w) as n", "cast(h div 10 as bigint) as g").selectExpr("*", "if(n > 0, g % n, null) as a")
    rows = rows.selectExpr("*", "cast(1 + (n - a) div (3 + g % 8) as int) as p", "cast(a as int) as b")
    tail = "slice(flatten(array_repeat(slice(w, b + 1, p), cast(ceil((n - b) / p) as int))), 1, n - b)"
    return rows.selectExpr("doc_id", f"if(a is null, text, array_join(concat(slice(w, 1, b), {tail}), ' ')) as text")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    run = "named_struct('start', 0L, 'length', 0L, 'period', 1L)"
    best = F.expr(f"aggregate(runs, {run}, (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")  # the first of equal ones
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"))


OP12_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda k: 0::BIGINT)),
             lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) AS h
  FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, a, p, w, unnest(range(n)) AS i FROM p),
words AS (SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM t),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
  WHERE 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, n, min(q) AS q FROM stretches GROUP BY doc_id, s, n),
said AS (
  SELECT doc_id, count(*)::BIGINT AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (n::HUGEINT * 1000000000000) // q DESC, s, q) = 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, n::BIGINT AS length, q::BIGINT AS period,
       (1000 * n // q)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN said ON said.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
