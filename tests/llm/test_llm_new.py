"""Periodic runs, vector codes and cells of vectors against plain versions, and their edge cases."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.llm import embedding_dedup, periodic_runs, queries, vector_codes

# --- periodic runs


def plain_runs(w, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(text, min_length=6, min_exponent=4):
    w = (text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    runs = plain_runs(w, min_length, min_exponent)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), [list(r) for r in runs], " ".join(x for i, x in enumerate(w) if i not in gone)


texts = st.lists(st.one_of(
    st.lists(st.sampled_from("ab"), max_size=40),
    st.lists(st.sampled_from("abc"), max_size=30),
    st.tuples(st.lists(st.sampled_from("abc"), max_size=5), st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(2, 8)).map(lambda t: t[0] + t[1] * t[2])), max_size=5)


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from([(6, 4), (2, 2), (5, 3), (1, 2.5)]))
def test_runs_equal_the_plain_search(several, bounds):
    got = periodic_runs.find_runs([np.array([ord(c) - 97 for c in t], dtype=np.int64) for t in several], *bounds)
    assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, t in enumerate(several) for r in plain_runs(t, *bounds)]


def test_runs_of_long_texts_and_over_blocks(monkeypatch):
    r = random.Random(4)
    some = [" ".join(r.choice("abcde") for _ in range(n)) for n in (0, 1, 700, 3)] + ["x y " * 3000, "z " * 5000 + "q", " ".join(f"w{i % 1500}" for i in range(7000)), "\n\t"]
    whole = periodic_runs.collapse(some)
    assert whole == [plain_collapse(t) for t in some]
    monkeypatch.setattr(periodic_runs, "BLOCK", 10)
    assert periodic_runs.collapse(some) == whole


def test_next_smaller_beyond_the_first_steps():
    r = np.random.default_rng(1)
    v = np.append(r.permutation(3000), -1)
    v[:100] = np.arange(5000, 5100)
    at = np.arange(3000)
    assert periodic_runs.next_smaller(v, at).tolist() == [next(j for j in range(i + 1, 3001) if v[j] < v[i]) for i in at]


def test_periodic_runs_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", None), (None, "a b " * 4, "x"), (4, "no run here", "x"), (4, "no run here", "x"),
            (5, "é è " * 6, "x"), (6, "go " * 6 + "on", "x"), (7, "a a a a a", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = {(r[0], r[1], tuple(map(tuple, r[2])), r[3]) for r in periodic_runs.periodic_runs(df).collect()}
    assert got == {(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (None, 8, ((0, 8, 2),), "a b"), (4, 3, (), "no run here"), (5, 6, ((0, 6, 1),), "é è"),
                   (6, 7, ((0, 6, 1),), "go on"), (7, 5, (), "a a a a a")}  # a no-break space divides nothing; five words are too few
    assert periodic_runs.periodic_runs(df).count() == len(rows) and periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, min_exponent=1.5)


def test_op12_as_registered_against_the_plain_version(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["to", "be", "or", f"w{r.randrange(40)}"]) for _ in range(r.randrange(0, 120)))) for i in range(150)] + [(None, "a b " * 9), (-5, None), (10**12, "  ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = set(), 0
    for i, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], planted + 1
        _, runs, kept = plain_collapse(" ".join(w))
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept)))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert planted > 5 and {tuple(x) for x in got} == want and len(got) == len(rows)


# --- vector codes


def plain_codes(rows, entries=64, rounds=2, parts=16):
    """{id: (code, error)} and codebooks of rows (id, components), in Python integers."""
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in sorted(rows)]
    wide = len(whole[0][1]) // parts
    books = [[v[p * wide:(p + 1) * wide] for _, v in whole[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v in whole:
                x = v[p * wide:(p + 1) * wide]
                mine.setdefault(nearest(books[p], x)[1], []).append(x)
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    out = {}
    for i, v in whole:
        best = [nearest(books[p], v[p * wide:(p + 1) * wide]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
    return out, books


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40), st.integers(1, 30), st.integers(0, 10**6), st.sampled_from([2, 9, 2**26]))
def test_partial_distance_search_is_exact(dim, n, entries, seed, top):
    r = np.random.default_rng(seed)
    x, book = r.integers(-top, top, (n, dim)), r.integers(-top, top, (entries, dim))
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    entry, best = vector_codes.search(x, book)
    assert entry.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()


def test_vector_codes_against_the_plain_version(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=(6, 32))
    rows = [(i, (centre[i % 6] + 0.3 * r.normal(size=32)).tolist(), None if i % 5 == 0 else i % 3) for i in range(300)]
    rows[7] = (7, [1e5] * 32, 1)
    bad = [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, 1)]
    want, books = plain_codes([(i, v) for i, v, _ in rows])
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    out, got_books = vector_codes.vector_codes(df.repartition(7))
    got = out.collect()
    assert {x["vec_id"]: (x["code"], x["error"]) for x in got} == want and len(got) == len(rows)
    sums = {}
    for i, _, label in rows:
        sums[label] = sums.get(label, 0) + want[i][1]
    assert all(x["label_error"] == sums[None if x["label"] is None else int(x["label"])] for x in got)
    said = ",".join(str(c) for b in books for e in b for c in e)
    assert got_books.sha256() == hashlib.sha256(said.encode()).hexdigest()


def test_vector_codes_edge_cases(spark):
    df = spark.createDataFrame([(3, [1.0] * 5, "a"), (3, [1.0] * 5, "a"), (None, [1e300, -1e300, 0.0, 0.0, 0.0], None), (4, [1.0], "a"), (5, [], "b"), (6, None, "b")],
                               "id int, v array<double>, label string").withColumn("code", F.lit(1))
    out, books = vector_codes.vector_codes(df, "id", "v", parts=4)
    got = sorted(map(tuple, out.collect()), key=str)
    assert books.values.shape == (3, 5) and books.cuts == [0, 1, 2, 3, 5]  # the most frequent length; three vectors have it
    assert got == sorted([(3, "a", "00000000", 0, 0)] * 2 + [(None, None, "02020202", 0, 0), (4, "a", None, None, 0), (5, "b", None, None, None)], key=str)
    assert books.values[2, 0] == vector_codes.most(5) == -books.values[2, 1]
    out, books = vector_codes.vector_codes(df.limit(0), "id", "v")
    assert out.count() == 0 and books is None
    out, books = vector_codes.vector_codes(df.where("id = 5"), "id", "v")
    assert [tuple(r) for r in out.collect()] == [(5, "b", "00" * 16, 0, 0)]


def test_label_sums_by_the_plan_for_many_labels(spark, monkeypatch):
    codes = spark.createDataFrame([(i, str(i % 7) if i % 4 else None, "00", i) for i in range(3000)], "id long, label string, code string, error long")
    small = sorted(map(str, vector_codes._labelled(codes).collect()))
    monkeypatch.setattr(vector_codes, "is_few", lambda t: False)
    assert sorted(map(str, vector_codes._labelled(codes).collect())) == small


# --- cells of the embedding search


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_given_labels_are_searched_in_several_cells(sf):
    """What a task of the registered query does with the labels of the given tables: k-means cells, none of them all."""
    import duckdb

    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    for label, vecs in duckdb.sql(f"SELECT label, list(embedding ORDER BY vec_id) FROM '{path}' WHERE label IS NOT NULL GROUP BY label ORDER BY label").fetchall():
        x = np.array([v for v in vecs if v and None not in v and np.isfinite(v).all() and any(v)], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        home, near = embedding_dedup.cells_of(x, float(np.sqrt(2 - 2 * embedding_dedup.LIMIT)))
        assert near.shape[1] == embedding_dedup.n_cells(len(x)) >= 8 and len(set(home.tolist())) > 1, label
        i, j = np.nonzero(x @ x.T >= embedding_dedup.LIMIT)
        assert near[j, home[i]].all()  # no link is lost
    assert [embedding_dedup.n_cells(n) for n in (2, 500, 640, 10**9)] == [8, 8, 10, 128] and [embedding_dedup.n_regions(n) for n in (1, 8193, 10**9)] == [1, 2, 1024]


def test_cells_prune_vectors_with_clusters():
    r = np.random.default_rng(3)
    centre = r.normal(size=(12, 32))
    x = np.concatenate([c + 0.02 * r.normal(size=(90, 32)) for c in centre])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, near = embedding_dedup.cells_of(x, float(np.sqrt(2 - 2 * 0.93)))
    assert near.mean() < 0.5


def test_packed_vectors_are_exact():
    for a in (np.array([0.1, 0.2]), np.array([0.5, -0.25]), np.array([1e300, 0.0]), np.float32([0.1, 0.7]).astype(np.float64)):
        assert (embedding_dedup.unit([embedding_dedup.packed(a)], 2) == embedding_dedup.unit([a.tobytes()])).all()
    assert len(embedding_dedup.packed(np.float32([0.1, 0.7]).astype(np.float64))) == 8 and len(embedding_dedup.packed(np.array([0.1, 0.2]))) == 16


def test_the_sample_is_bounded_where_ids_are_null(spark, monkeypatch):
    """Many rows under one (null) id: the sample goes by vector too, and is no larger than its bound."""
    r = np.random.default_rng(8)
    near = np.eye(4)
    rows = [(None, (near[i % 4] + 0.01 * r.normal(size=4)).tolist(), 0) for i in range(4000)] + [(1, [1.0, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 1000)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 50)
    seen = []
    fit = embedding_dedup.spherical_kmeans
    monkeypatch.setattr(embedding_dedup, "spherical_kmeans", lambda x, k, *a: (seen.append((len(x), k)), fit(x, k, *a))[1])
    got = embedding_dedup.embedding_dedup(df).collect()
    assert seen == [(50, 5)] and len(got) == 4001
    one = next(x for x in got if x["vec_id"] == 1)
    assert one["n_links"] == 1000 and sum(x["n_links"] for x in got if x["vec_id"] is None) == 1000  # rows of one id link with others only
