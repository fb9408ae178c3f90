"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of word hashes (runs of ASCII letters, digits and all non-ASCII characters; A-Z
lower-cased).  A CGK walk copies the word under its pointer at each step and moves the pointer on by a random bit that
depends on the step and the word, so two sequences within a small edit distance soon walk in step and their embeddings
are close in Hamming distance.  Each of ROUNDS walks samples a few steps of the embedding as an LSH key (two steps for
items of up to SHORT words, one for longer ones, which lose step more often).  Item-sized windows of a text are hashed
the same way, and an item is a candidate of a window if their keys meet in any round: nothing else names candidates.  The
edit distance of each candidate, over the window widened by the edits allowed, is then computed exactly.

Windows are pruned without regard to items: one of n words is hashed only where it starts where some item of n words
would, had it the run of SEED words that stands here, and only if, widened, it holds as many runs that occur in any item
as a match must (q-gram lemma: e edits leave n - 2 - 3 e of the runs of three).  That loses no match; the keys may.
Measured at exactly 20 % edits (deleted, inserted, replaced, evenly spread or at both ends; 10 to 400 words; 60 trials
each), 48 rounds of two steps find 0.98 or more up to 100 words, and 16 rounds of one step 0.98 or more from there on;
fewer edits are found more surely, none in all cases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import python_side, written
from .shingles import mix

EDITS, SEED, ROUNDS, SHORT = 0.2, 3, 64, 64
#: Items that are held by a task at once; more items are done in further passes.
ITEMS = 20_000
#: Words of windows that are compared at once.
CELLS = 200_000
#: Windows that are hashed at once.
WINDOWS = 50_000

_BREAK = np.zeros(256, dtype=bool)
_BREAK[:128] = [not chr(i).isalnum() for i in range(128)]
_NOTHING = np.uint64(0)


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Word hashes of the rows in data, and the row of each."""
    plain = np.where(_BREAK[data], np.uint8(32), data)
    h, row, _, _ = shingles.words(plain, offsets)
    return h | np.uint64(1), row  # never _NOTHING


def _walk(words: np.ndarray, start: np.ndarray, size: np.ndarray, round_: int, steps: np.ndarray) -> np.ndarray:
    """LSH keys of words[start : start + size] in one round: steps are the (sorted) sampled steps for each row, as
    shares of the walk of 2 * size steps."""
    at = np.zeros(len(start), dtype=np.int64)
    key = np.full(len(start), np.uint64(round_ + 1), dtype=np.uint64)
    taken = np.zeros(len(start), dtype=np.int64)
    end = int(steps.max()) + 1 if len(start) else 0
    for j in range(end):
        inside = at < size
        w = np.where(inside, words[np.minimum(start + at, len(words) - 1)], _NOTHING)
        now = (steps == j).sum(axis=1)
        if now.any():
            key = np.where(now > 0, mix(key ^ (w + np.uint64(j))), key)
        bit = mix(w ^ np.uint64(((round_ << 20) + j) * 0x9E3779B97F4A7C15 & shingles.M64)) >> np.uint64(63)
        at += bit.astype(np.int64)
        taken += now
    return key


def _sampled(size: np.ndarray, round_: int) -> np.ndarray:
    """The sampled steps of a walk for sequences of each size; one pattern a round and size."""
    u = np.random.default_rng(1000 + round_).random(2)
    at = np.floor(u[None, :] * 1.5 * size[:, None]).astype(np.int64)
    at[size > SHORT, 1] = at[size > SHORT, 0]  # the same step twice
    return np.sort(at, axis=1)


def keys_of(words: np.ndarray, start: np.ndarray, here: np.ndarray, size: np.ndarray, round_: int) -> np.ndarray:
    """LSH keys in one round of windows words[start : start + here] as items of `size` words."""
    return mix(_walk(words, start, here, round_, _sampled(size, round_)) ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def edit_distances(a: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least edit distance (insert, delete, replace a word) of a to any part of text[lo : hi], for each window."""
    width = int((hi - lo).max())
    best = np.zeros((len(lo), width + 1), dtype=np.int32)  # a part may begin anywhere
    cols = lo[:, None] + np.arange(width)
    valid = cols < hi[:, None]
    w = np.where(valid, text[np.minimum(cols, len(text) - 1)], _NOTHING)
    ramp = np.arange(width + 1, dtype=np.int32)
    for x in a:
        new = np.empty_like(best)
        new[:, 0] = best[:, 0] + 1
        new[:, 1:] = np.minimum(best[:, 1:] + 1, best[:, :-1] + (w != x))
        best = np.minimum.accumulate(new - ramp, axis=1) + ramp  # insertions run along the row
    return np.where(np.concatenate((np.ones((len(lo), 1), bool), valid), axis=1), best, 1 << 30).min(axis=1)


@dataclass
class Items:
    """The benchmark as arrays: item ids, words, first word and length of each, runs and LSH keys."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    seed: np.ndarray  # sorted hashes of SEED words in a row (of all words where an item has fewer), of all items
    seed_at: np.ndarray  # with each, where it stands in an item and how many words that item has; which item is not kept
    seed_size: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray]]  # for each round the sorted LSH keys and their items

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        data, offsets = next(((d, o) for _, d, o in _whole(pa.array(texts, pa.string()))), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        h, row = word_hashes(data, offsets)
        size = np.bincount(row, minlength=len(ids)).astype(np.int64)
        first = np.cumsum(size) - size
        runs = [np.zeros((3, 0), dtype=np.uint64)]
        for n in np.unique(size[size > 0]).tolist():
            k, some = min(SEED, n), np.flatnonzero(size == n)
            at = np.arange(n - k + 1)
            where = (first[some][:, None] + at).ravel()
            grams = _gram(np.concatenate([h, np.zeros(SEED, np.uint64)]), k)[where]
            runs.append(np.stack((grams, np.tile(at, len(some)).astype(np.uint64), np.full(len(where), n, np.uint64))))
        seed, at, of = np.unique(np.concatenate(runs, axis=1), axis=1)
        full = np.flatnonzero(size)
        keys = []
        for r in range(ROUNDS if len(full) else 0):
            key = keys_of(h, first[full], size[full], size[full], r)
            order = np.argsort(key, kind="stable")
            keys.append((key[order], full[order]))
        return cls(np.array(ids, dtype=np.int64), h, first, size, seed, at.astype(np.int64), of.astype(np.int64), keys)

    def allowed(self) -> np.ndarray:
        return edits_allowed(self.size)


def edits_allowed(size: np.ndarray) -> np.ndarray:
    """Edits allowed by number of words; items under 7 words must match as they are."""
    return np.where(size >= 7, np.floor(EDITS * size), 0).astype(np.int64)


def _whole(texts: pa.Array):
    """All rows as one chunk."""
    texts = texts.cast(pa.large_string())
    if len(texts):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        yield 0, data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _gram(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words in h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    s = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        s = mix(s ^ h[j:j + n]) if k < SEED else s * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return mix(s)


def _least_edits(items: Items, item: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each window h[lo : hi] a lower bound of its edit distance to the item: words of the item, less the words of
    the window that occur in the item, since each word left unedited is one of them."""
    out = items.size[item].copy()
    order = np.argsort(item, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []:
        i = int(item[some[0]])
        own = np.sort(items.words[items.first[i]:items.first[i] + items.size[i]])
        width = int((hi[some] - lo[some]).max())
        for part in np.array_split(some, -(-len(some) * width // CELLS)):
            at = lo[part][:, None] + np.arange(width)
            w = h[np.minimum(at, len(h) - 1)]
            held = own[np.minimum(np.searchsorted(own, w), len(own) - 1)] == w
            out[part] -= (held & (at < hi[part][:, None])).sum(axis=1)
    return np.maximum(out, 0)


def _confirm(out, base, row, h, items: Items, allowed, some, item, start, begin, stop) -> None:
    """Enters the windows `some` that match, by exact edit distance, into the texts' dicts."""
    order = some[np.argsort(item[some], kind="stable")]
    for mine in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []:
        i = int(item[mine[0]])
        n, e, a = int(items.size[i]), int(allowed[i]), items.first[i]
        for part in np.array_split(mine, -(-len(mine) * (n + 2 * e) // CELLS)):
            lo = np.maximum(start[part] - e, begin[part])
            hi = np.minimum(start[part] + n + e, stop[part])
            d = edit_distances(items.words[a:a + n], h, lo, hi)
            for s, x in zip(start[part].tolist(), d.tolist(), strict=True):
                if x <= e:
                    doc = out[base + int(row[s])]
                    doc[i] = min(x, doc.get(i, x))


def spread(first: np.ndarray, count: np.ndarray, most: int = 1 << 21):
    """Rows and the positions first .. first + count - 1 of each, in parts of about `most` positions."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        n = count[at:to]
        yield np.repeat(np.arange(at, to), n), np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = to


def windows(items: Items, h: np.ndarray, begin: np.ndarray, stop: np.ndarray):
    """Start, size, first word of the text and end of the text of each window that is hashed; begin and stop are by word."""
    out = [np.zeros((4, 0), dtype=np.int64)]
    for k in sorted({min(SEED, int(n)) for n in np.unique(items.size) if n}):
        g = _gram(h, k)
        lo = np.searchsorted(items.seed, g, side="left")
        held = items.seed[np.minimum(lo, len(items.seed) - 1)] == g
        held &= stop[: len(g)] - np.arange(len(g)) >= k  # the run ends in the same text
        found = np.flatnonzero(held)
        upto = np.concatenate(([0], np.cumsum(held)))
        count = np.searchsorted(items.seed, g[found], side="right") - lo[found]
        for row, which in spread(lo[found], count):
            p, size = found[row], items.seed_size[which]
            mine = np.minimum(size, SEED) == k
            p, size, which = p[mine], size[mine], which[mine]
            start, e = np.maximum(p - items.seed_at[which], begin[p]), edits_allowed(size)
            first, last = np.maximum(start - e, begin[p]), np.minimum(start + size + e, stop[p]) - k + 1
            runs = upto[np.clip(last, 0, len(g))] - upto[first]
            ok = (np.minimum(size, stop[p] - start) >= size - e) & (runs >= size - k + 1 - k * e)
            out.append(np.unique(np.stack((start, size, begin[p], stop[p]))[:, ok], axis=1))
    return np.unique(np.concatenate(out, axis=1), axis=1)


def candidates(items: Items, h: np.ndarray, start: np.ndarray, size: np.ndarray, stop: np.ndarray):
    """Pairs (window, item) whose keys meet in a round."""
    here = np.minimum(size, stop - start)
    pairs = np.zeros(0, dtype=np.int64)
    for r, (keys, item) in enumerate(items.keys):
        mine = keys_of(h, start, here, size, r)
        lo = np.searchsorted(keys, mine, side="left")
        for row, which in spread(lo, np.searchsorted(keys, mine, side="right") - lo):
            pairs = np.union1d(pairs, row * len(items.size) + item[which])
    return pairs // len(items.size), pairs % len(items.size)


def find(texts: pa.Array, items: Items) -> list[dict[int, int]]:
    """For each text the items that it holds, with the least edit distance seen."""
    out: list[dict[int, int]] = [{} for _ in range(len(texts))]
    if not len(items.seed):
        return out
    allowed = items.allowed()
    for base, data, offsets in shingles.chunks(texts):
        h, row = word_hashes(data, offsets)
        if not len(h):
            continue
        n = np.bincount(row, minlength=len(offsets) - 1)
        begin = (np.cumsum(n) - n)[row]
        start, size, begin, stop = windows(items, h, begin, begin + n[row])
        for lo in range(0, len(start), WINDOWS):
            at, item = candidates(items, h, *(x[lo:lo + WINDOWS] for x in (start, size, stop)))
            at += lo
            e = allowed[item]
            few = _least_edits(items, item, h, np.maximum(start[at] - e, begin[at]), np.minimum(start[at] + size[at] + e, stop[at]))
            some = np.flatnonzero(few <= e)
            _confirm(out, base, row, h, items, allowed, some, item, start[at], begin[at], stop[at])
    return out


def _item_blocks(benchmark: DataFrame, item_col: str, item_text: str):
    """The benchmark as broadcasts of Items, at most about ITEMS items each, one after the other, and whether more follow."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.where(F.col(item_col).isNotNull() & (F.length(F.trim(item_text)) > 0)).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    parts = max(1, -(-items.count() // ITEMS))
    for p in range(parts):
        rows = sorted(map(tuple, items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).collect()))
        yield sc.broadcast(Items.of([r[0] for r in rows], [r[1] for r in rows])), p + 1 < parts


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs, whatever its id: id, contaminated, n_matches (items found), items (their ids,
    ascending), best (highest 1 - edits / words of a match; null without one).  Null, empty and wordless texts match
    nothing, nor do such items; items with a null id are left out, those that share an id are one; an empty benchmark
    finds nothing.  Items are held ITEMS at a time, so what a task holds has a bound; a larger benchmark takes more
    passes over docs, each of which adds what it finds to the rows."""
    python_side(docs.sparkSession)
    found = "items array<long>, best double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"),
                       F.array().cast("array<bigint>").alias("items"), F.lit(None).cast("double").alias("best"))
    for k, (items, more) in enumerate(_item_blocks(benchmark, item_col, item_text)):

        def run(batches, items=items, more=more):
            for batch in batches:
                got = find(batch.column(1), items.value)
                ids = [sorted({*held, *(int(items.value.ids[i]) for i in g)}) for held, g in zip(batch.column(2).to_pylist(), got, strict=True)]
                best = [max(([] if b is None else [b]) + [1 - d / int(items.value.size[i]) for i, d in g.items()], default=None)
                        for b, g in zip(batch.column(3).to_pylist(), got, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1) if more else pa.nulls(len(got), pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())],
                    names=["doc_id", "_text", "items", "best"])

        rows = (rows if k == 0 else written(rows, "pass")).mapInArrow(run, f"doc_id long, _text string, {found}")
    n = F.size("items").cast("long")
    return rows.select(F.col("doc_id").alias(id_col), (n > 0).alias("contaminated"), n.alias("n_matches"), "items", "best")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that hold no benchmark item.  No shuffle, whatever the size."""
    python_side(docs.sparkSession)
    at = docs.columns.index(text_col)
    for k, (items, _) in enumerate(_item_blocks(benchmark, item_col, item_text)):

        def run(batches, items=items):
            for batch in batches:
                yield batch.filter(pa.array([not g for g in find(batch.column(at), items.value)], pa.bool_()))

        docs = (docs if k == 0 else written(docs, "pass")).mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
