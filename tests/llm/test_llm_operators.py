"""The training-data operators on small tables: edge cases, and plain Python versions of what SQL can't say."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowage.llm import chat_format, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, pii, url_filter
from stowage.llm.graph import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names clash with those that operators make.
CLASH = ["rep", "score", "kept", "node", "id", "a", "_n"]


def docs(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH)) if clash else df


def words(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# --- components


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (201, 200)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- op1


def plain_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < 3 or (-1 if i is None else i) == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_line_dedup(spark, monkeypatch):
    line, other, long_ = "A shared line of text, é", "another line that is shared", "x" * 30_000
    rows = [(1, f"{line}\nown\n{other}"), (2, f"  {line.upper().replace('É', 'é')}\t\n\n{line}"), (3, f"{line}\r\n{other}"), (4, other + "\nshort"), (5, None), (6, ""), (7, long_), (7, long_), (8, long_), (9, long_),
            (None, other), (10, "\n".join([f"line number {i} is long enough" for i in range(200)]))]
    df = docs(spark, rows, clash=True)
    for most in (1000, 1):  # with 1, the commonest keys go the way of hot ones
        real = line_dedup.hot_keys
        monkeypatch.setattr(line_dedup, "hot_keys", lambda r, k, m=most, f=real: f(r, k, 1000, m))
        out = line_dedup.line_dedup(df)
        assert sorted((tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str) == plain_lines(rows)
        assert set(CLASH) <= set(out.columns)
        monkeypatch.setattr(line_dedup, "hot_keys", real)
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


# --- op2


def test_reply_trees(spark):
    schema = "conv_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double"
    rows = [(1, 1, None, "system", "be [INST] </s> \\ good", 0.0), (1, 2, 1, "user", None, 0.0), (1, 3, 2, "assistant", "bad", 1.0), (1, 4, 2, "assistant", "a<\\b", 5.0), (1, 5, 4, "user", "q", 0.0),
            (1, 6, 5, "tool]<x", "t", None), (2, 1, 9, None, "orphan", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, "assistant", "null conversation", 0.0)]
    df = spark.createDataFrame(rows, schema).withColumn("depth", F.lit(0))
    out = chat_format.format_reply_trees(df).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == {1, 2, None}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("system", "be [INST] </s> \\ good"), ("user", ""), ("assistant", "a<\\b"), ("user", "q"), ("tool]<x", "t")]
    assert got[1]["loss"] == "a<\\b" and got[1]["leaf_id"] == 6 and got[1]["path_score"] == 5.0
    assert [t["role"] for t in got[2]["turns"]] == [None] and got[None]["loss"] == "null conversation"
    both = chat_format.reply_paths(df, top=2).where("conv_id = 1").select("path_rank", "msg_id").orderBy("path_rank", "depth").collect()
    assert [tuple(r) for r in both] == [(1, 1), (1, 2), (1, 4), (1, 5), (1, 6), (2, 1), (2, 2), (2, 3)]
    assert chat_format.format_reply_trees(df.limit(0)).count() == 0


def test_long_chain_and_escapes(spark):
    r = random.Random(3)
    text = lambda: "".join(r.choice("<>[]/\\sINST \né") for _ in range(r.randrange(30)))
    rows = [(1, i, r.choice(["user", "assistant", "system", None, "x"]), text()) for i in range(300)]
    df = chat_format.linear_chains(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = chat_format.format_reply_trees(df).select(chat_format.read_back(F.col("formatted")), chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert [(t["role"], t["text"]) for t in got[0]] == [(x[2], x[3]) for x in rows]
    assert got[1] == "".join(x[3] for x in rows if x[2] == "assistant")


# --- op3


@pytest.fixture(scope="module")
def boosted():
    return html_extract.trained()


def test_pages_of_another_seed(boosted):
    pages = html_extract.make_pages(150, seed=4242)
    got = html_extract.extract([p for p, _ in pages], boosted)
    assert sum(g == "\n".join(m) for g, (_, m) in zip(got, pages, strict=True)) >= 147


def test_html_reading(boosted):
    article = "<article><h1>A &amp; B</h1><p>First  line\n of a paragraph that goes on for a while, with words.<p>Second &lt;one&gt; &#233;, also long enough to be text.</article>"
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{article}<script>var x = '</p>';</script><footer>&copy; us</footer>"
    want = "A & B\nFirst line of a paragraph that goes on for a while, with words.\nSecond <one> é, also long enough to be text."
    assert html_extract.extract([page, None, "", "<", "<!-- <p>x"], boosted)[0] == want
    assert html_extract.extract([None, "", "<!-- <p>x", "<div"], boosted) == ["", "", "", ""]
    long_ = "<article>" + "<p>Some words of text, again and again.</p>" * 20_000 + "</article>"
    assert html_extract.extract([long_], boosted)[0].count("\n") == 19_999
    deep = "<div>" * 5000 + "<p>x</p>"
    html_extract.extract([deep], boosted)


def test_decoding_never_contradicts():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(1, 12))
        parent = [-1] + [int(r.integers(0, i)) for i in range(1, n)]
        w = r.normal(size=n)
        keep = html_extract.decode(parent, w)
        best = max((sum(w[i] for i in range(n) if m >> i & 1) for m in range(1 << n) if all(i == 0 or not m >> i & 1 or m >> parent[i] & 1 for i in range(n))))
        assert all(keep[parent[i]] for i in range(1, n) if keep[i]) and abs(sum(w[i] for i in range(n) if keep[i]) - best) < 1e-9


def test_main_text_table(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>")], "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    assert sorted((tuple(r) for r in html_extract.main_text(df).collect()), key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0)], key=str)
    assert html_extract.main_text(df.limit(0)).count() == 0


# --- op4


def phrases(text: str, corpus: str) -> int:
    """Greedy phrases of one block, the plain way."""
    i, n = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i:i + k + 1] in corpus:
            k += 1
        i, n = i + k, n + 1
    return n


def test_cross_parsing_against_plain_search():
    r = random.Random(1)
    texts = {"x": "".join(r.choice("abcd ") for _ in range(600)), "y": "".join(r.choice("bcde ") for _ in range(600))}
    m = language_id.LanguageModel.fit(texts)
    clean = lambda t: re.sub("[^a-z]+", " ", t)
    for _ in range(30):
        t = clean("".join(r.choice("abcdef ") for _ in range(r.randrange(1, 250))))
        f, _ = m.phrases([t])
        # a character that the corpus lacks is a phrase, and what follows it begins a new one
        assert f[0].tolist() == [phrases(t, clean(texts[k])) for k in m.languages]


def test_languages_and_edge_cases(spark):
    english, german = "the cat and the dog were in the house with some other things ", "der hund und die katze waren in dem haus mit einigen anderen dingen "
    rows = [(i, (english if i % 2 else german) * (i % 5 + 1), "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df)
    test = docs(spark, [(1, english), (2, german * 3000), (3, None), (4, ""), (5, "123 !?"), (6, english), (6, english), (None, "der hund")], clash=True)
    got = language_id.identify(test, model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en"), (None, "de")]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [r["doc_id"] for r in language_id.keep_known(test, model).collect()] == [1, 2, 6, 6, None] and language_id.keep_known(test, model).columns == test.columns
    assert language_id.identify(test.limit(0), model).count() == 0
    none = language_id.train(df.where("false"))
    assert none.predict(["the"])[0] == ["und"]


# --- op5


def test_targets_stop_at_twice_the_size():
    t = mixing.targets({"a": 10, "b": 100, "c": 10, None: 0})
    assert t["a"] == 20 and t["c"] == 20 and abs(sum(t.values()) - 180) < 1e-9 and t[None] == 0.0


def test_flow_prefers_first_copies_and_meets_quotas():
    f = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10})
    assert sum(v for (p, s), v in f.items() if s == "a") == 20 and sum(v for (p, s), v in f.items() if s == "b") == 10
    assert all(sum(v for (q, _), v in f.items() if q == p) <= 10 for p in [("a",), ("a", "b"), ("b",)])  # no copy is repeated
    g = mixing.min_cost_flow({("a",): 10}, {"a": 17})
    assert g == {(("a",), "a"): 17}


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)) if i % 11 else None, [["a"], ["b"], ["a", "b"], None, ["c", "c"]][i % 5]) for i in range(400)] + [(None, "x y", []), (7, "again", ["a"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>").withColumn("taken", F.lit(1))
    one, two = mixing.mix(df).collect(), mixing.mix(df).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 402
    assert all(0 <= x["taken"] <= 2 * x["size"] for x in one)
    want = int(1.5 * sum(x["size"] for x in one))
    assert abs(sum(x["taken"] for x in one) - want) <= 4
    assert mixing.mix(df.limit(0)).count() == 0


def test_single_source_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), f"s{i % 7}" if i % 13 else None) for i in range(500)]
    got = mixing.mix_single(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in got)


# --- op6


def test_embedding_links_against_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    centers = r.normal(size=(12, 8))
    vecs = [(centers[i % 12] + r.normal(size=8) * (0.05 if i % 3 else 0.6)).tolist() for i in range(300)]
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)] + [(1000, vecs[0], None), (1001, None, 0), (1002, [0.0] * 8, 0), (1003, [float("nan")] * 8, 0), (1004, vecs[0][:4], 0), (1005, [1e-300] * 8, 0), (1006, [], 0), (1007, [None] * 8, 0), (3, vecs[3], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("cell", F.lit(1))
    want, adj = {}, {}
    for i, v, l in rows:
        adj.setdefault(i, set())
        for j, u, k in rows:
            if i != j and l is not None and l == k and v and u and len(v) == len(u) and None not in v + u:
                x, y = np.array(v) / max(map(abs, v), default=1) if any(v) else np.zeros(len(v)), np.array(u) / max(map(abs, u), default=1) if any(u) else np.zeros(len(u))
                n = np.linalg.norm(x) * np.linalg.norm(y)
                if np.isfinite(n) and n > 0 and x @ y / n >= 0.93:
                    adj[i].add(j)
    for i in adj:
        seen, todo = {i}, [i]
        while todo:
            for j in adj[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = min(seen)
    cosine = lambda v, u: np.dot(v, u) / np.linalg.norm(v) / np.linalg.norm(u)
    able = [(i, v, l) for i, v, l in rows if l is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all() and max(map(abs, v)) > 1e-200]
    of_rows = sorted((i, sum(i != j and l == k and cosine(v, u) >= 0.93 for j, u, k in able)) for i, v, l in able)
    for rows_, block in ((2000, 8192), (20, 16)):
        monkeypatch.setattr(embedding_dedup, "CELL_ROWS", rows_)
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        monkeypatch.setattr(embedding_dedup, "TILE", max(5, block // 8))
        all_rows = embedding_dedup.embedding_dedup(df).collect()
        assert sorted((x["vec_id"], x["n_links"]) for x in all_rows if x["vec_id"] < 1000) == of_rows  # two rows are vector 3
        got = {x["vec_id"]: x for x in all_rows}
        assert {i: x["component_id"] for i, x in got.items()} == want
        assert all(x["n_links"] == len(adj[i]) for i, x in got.items() if i != 3 and 3 not in adj[i])
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_wide_vectors_need_little_memory():
    import tracemalloc

    r = np.random.default_rng(6)
    c = embedding_dedup.spherical_kmeans(embedding_dedup.unit([v.tobytes() for v in r.normal(size=(1024, 768))]), 1024, rounds=1)
    x = embedding_dedup.unit([v.tobytes() for v in r.normal(size=(1000, 768))])
    tracemalloc.start()
    embedding_dedup.nearby(x, c, 0.374, embedding_dedup.gaps(c))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_a_repeated_id_is_one_vertex_with_rows_of_its_own(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [0.01, 1.0], 0)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True), (2, 1, 1, False), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False)]


def test_many_cells_lose_no_link():
    r = np.random.default_rng(5)
    x = embedding_dedup.unit([v.tobytes() for v in r.normal(size=(400, 6))])
    reach = float(np.sqrt(2 - 2 * 0.93))
    for k in (2, 9, 40):
        home, near = embedding_dedup.nearby(x, embedding_dedup.spherical_kmeans(x, k), reach)
        i, j = np.nonzero(x @ x.T >= 0.93)
        assert near[j, home[i]].all()


# --- op7


def test_urls(spark):
    rows = [(1, "https://A.Example.ORG:80/es/x?q#f"), (2, "http://example.org/en/12"), (3, "x://notexample.org/en/1"), (4, "no scheme"), (5, None), (6, "https://b.com?x=/de/"), (7, "https://b.com/de/1"), (7, "https://b.com/de/1"),
            (8, "https://bad.net/x"), (9, "https://x.bad.net/x"), (10, "https://good.net/y"), (11, "a://é.com#b://c"), (None, "https://q.com/fr/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("blocked", F.lit(1))
    outcomes = spark.createDataFrame([("bad.net", 1)] * 40 + [("good.net", 0)] * 200 + [("ok.com", None)], "host string, bad int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, outcomes).collect()}
    assert got[1] == ("a.example.org:80", "/es/x", None, "allow")  # a port is part of the host
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6] == ("b.com", "", None, "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8][3] == "block" and got[10][3] == "allow" and got[11][:2] == ("é.com", "") and got[None][2] == "com/fr/"
    assert url_filter.judge_urls(pages, outcomes.limit(0)).where("verdict = 'block'").count() == 3 and url_filter.judge_urls(pages.limit(0), outcomes).count() == 0
    rep = {r["host"]: r for r in url_filter.host_reputation(outcomes).collect()}
    assert rep["bad.net"]["rate"] < 1 and rep["good.net"]["rate"] > 0 and "ok.com" not in rep


def test_hosts_without_labels_stand_on_their_domain(spark):
    rows = [(1, "https://x.bad.net/x"), (2, "https://y.good.net/x"), (3, "https://bad.net/x"), (4, "https://new.xyz/x"), (5, "no scheme")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    outcomes = spark.createDataFrame([("bad.net", 1)] * 40 + [("good.net", 0)] * 200, "host string, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, outcomes).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    new = spark.createDataFrame([("x.bad.net",)] * 2, "host string")
    one, two = ({r["host"]: r for r in url_filter.host_reputation(outcomes, hosts=h).collect()} for h in (None, new))
    assert set(two) == {*one, "x.bad.net"} and all(two[h] == r for h, r in one.items()) and two["x.bad.net"]["n"] == 0
    assert url_filter.host_reputation(outcomes.limit(0), hosts=new).count() == 0


# --- op8


def edits(a, b):
    """Least edit distance of a to any part of b."""
    best = [0] * (len(b) + 1)
    for x in a:
        new = [best[0] + 1]
        for j, y in enumerate(b):
            new.append(min(best[j + 1] + 1, best[j] + (x != y), new[j] + 1))
        best = new
    return min(best)


def test_edited_passages_are_found():
    r = random.Random(6)
    items = [[f"i{k}x{r.randrange(60)}" for _ in range(r.randrange(12, 50))] for k in range(60)]
    table = decontaminate.Items.of(list(range(60)), [" ".join(i) for i in items])
    texts, want = [], []
    for n in range(600):
        item = items[n % 60]
        body = list(item)
        for _ in range(r.randrange(0, int(0.2 * len(item)) + 4)):
            k = r.randrange(len(body))
            body[k:k + r.choice([0, 1])] = [] if r.random() < 0.4 else [f"n{r.randrange(99)}"]
        t = words(r.randrange(0, 60), n) + body + words(r.randrange(0, 60), n + 1)
        texts.append(" ".join(t))
        want.append(edits(item, t) <= int(0.2 * len(item)))
    got = [n % 60 in f for n, f in enumerate(decontaminate.find(pa.array(texts), table))]
    assert not any(g and not w for g, w in zip(got, want, strict=True))  # exact check: none too many
    assert sum(g for g, w in zip(got, want, strict=True) if w) >= 0.99 * sum(want)


def test_matches_at_the_limit_are_all_found():
    r = random.Random(16)
    for n in (15, 50, 100, 200, 400):
        items = [[f"i{k}x{j}" for j in range(n)] for k in range(10)]
        table = decontaminate.Items.of(list(range(10)), [" ".join(i) for i in items])
        e = int(0.2 * n)
        for kind in ("delete", "insert", "replace", "spread"):
            texts = []
            for item in items:
                body = list(item)
                places = [5 * j + 2 for j in range(e)] if kind == "spread" else sorted(r.sample(range(1, n - 1), e))
                for k in reversed(places):
                    body[k:k + (kind != "insert")] = [] if kind == "delete" else [f"n{r.randrange(10**6)}"]
                texts.append(" ".join(words(20, k) + body + words(20, k + 1)))
            assert [g.get(k) for k, g in enumerate(decontaminate.find(pa.array(texts), table))] == [e] * 10, (n, kind)


def test_decontamination_edge_cases(spark):
    item = " ".join(words(30, 1))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "a b c"), (4, "Two words"), (5, "!!")], "item_id bigint, text string")
    rows = [(1, f"{item.upper()}!"), (2, None), (3, ""), (4, "xx two, WORDS yy"), (5, "two\nlong\nwords"), (6, " ".join(words(200_000, 9)) + " " + item), (7, item), (7, item), (None, item)]
    df = docs(spark, rows, clash=True)
    got = decontaminate.contamination(df, bench).select("doc_id", "items").collect()
    assert [(r[0], r[1]) for r in got] == [(1, [1]), (2, []), (3, []), (4, [4]), (5, []), (6, [1]), (7, [1]), (7, [1]), (None, [1])]
    assert [r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()] == [2, 3, 5] and decontaminate.keep_clean(df, bench).columns == df.columns
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.contamination(df.limit(0), bench).count() == 0


def test_many_items_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    bench = spark.createDataFrame([(i, " ".join(words(20, i))) for i in range(10)], "item_id bigint, text string")
    df = docs(spark, [(i, " ".join(words(20, i) + words(20, (i + 1) % 10))) for i in range(10)])
    got = {r["doc_id"]: r["items"] for r in decontaminate.contamination(df, bench).collect()}
    assert got == {i: sorted({i, (i + 1) % 10}) for i in range(10)} and decontaminate.keep_clean(df, bench).count() == 0


# --- op9


def plain_near(rows, percent=75):
    sets = []
    for i, t in rows:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((near_dedup.NO_ID if i is None else i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_rows(r):
    rows, n = [], 0
    for g in range(12):
        base = words(r.randrange(20, 120), g)
        for _ in range(r.choice([1, 2, 3, 40])):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = f"e{r.randrange(1000)}"
            rows.append((n, " ".join(t)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Few words"), (n + 4, "few WORDS"), (n + 5, rows[0][1]), (3, rows[-1][1]), (None, rows[0][1]), (n + 6, " ".join(words(60_000, 77))), (n + 7, " ".join(words(60_000, 77)))]


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    rows = near_rows(random.Random(8))
    df = docs(spark, rows, clash=True)
    for node, group in ((64, 256), (4, 8)):  # with small bounds most nodes and clusters are dealt in blocks
        monkeypatch.setattr(near_dedup, "NODE", node)
        monkeypatch.setattr(near_dedup, "GROUP", group)
        got = near_dedup.near_duplicates(df).collect()
        assert sorted((near_dedup.NO_ID if r[0] is None else r[0], r[1], r[2]) for r in got) == plain_near(rows)
        assert all(r["kept"] == ((near_dedup.NO_ID if r["doc_id"] is None else r["doc_id"]) == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_borderline_copy_of_a_large_group_is_found(spark):
    """With seed 42 the copy shares no node of the deepest level with the group in any of the first 12 trees."""
    r = random.Random(42)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    copy = list(base)
    for k in (20, 60, 100, 140, 180):
        copy[k] = f"m{r.randrange(10**6)}"
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(100)] + [(1000, " ".join(copy))]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == dict.fromkeys([i for i, _ in rows], 0)
    parts = 1 - 0.75 * (1 - 0.25**near_dedup.BRANCH) ** (near_dedup.LEVELS - 1)  # in one tree whose nodes stay open
    assert parts**near_dedup.TREES < 1e-5


def test_a_chain_in_blocks_is_followed(monkeypatch):
    """linked() is exact, on any sizes."""
    r = random.Random(9)
    sets = [np.unique(np.array([r.randrange(60) for _ in range(r.randrange(0, 40))], dtype=np.uint64)) for _ in range(40)]
    got = near_dedup.linked(sets, 75)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            n = len(set(a) & set(b))
            assert got[i, j] == (n > 0 and 100 * n >= 75 * (len(a) + len(b) - n))


# --- op10


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_patterns_against_plain_regular_expressions():
    r = random.Random(10)
    parts = ["a@b.c", "x.y@z", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "++", ".", "-", " ", "é", "12", "007", "0.0.0.0", "\n", "a%b+c@d-e.f.g", "+1234567890123456", "@@x.y"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.fixture(scope="module")
def crf():
    return pii.trained()


def test_crf_on_a_held_out_table(crf):
    rows = pii.make_table(400, seed=321)
    pairs = [(label, pii.LABELS[k]) for row, path in zip(rows, crf.decode([[t for t, _ in r] for r in rows]), strict=True) for (_, label), k in zip(row, path, strict=True)]
    assert np.mean([a == b for a, b in pairs]) > 0.96
    said = [a == b for a, b in pairs if b != "O"]
    assert np.mean(said) > 0.95


def test_viterbi_against_all_paths(crf):
    import itertools

    r = random.Random(11)
    for _ in range(20):
        run = [r.choice(["tel", "(555)", "123-4567", "a", "12", "x(at)y.de", "::1"]) for _ in range(4)]
        score = lambda p, run=run: crf.start[p[0]] + sum(crf.scores(t)[k] for t, k in zip(run, p, strict=True)) + sum(crf.move[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=score)
        assert abs(score(tuple(crf.decode([run])[0])) - score(best)) < 1e-9


def test_secrets_are_found_by_what_announces_them(crf):
    h = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    found = lambda t: [(pii.FOUND[k], t[a:b]) for a, k, b in pii.find_pii([t], crf)[0][1]]
    for t in (f'so token = "{h}" it is', f'so! TOKEN = "{h}"### it', f"my api_key: {h} here", f"a secret = {h}."):
        assert found(t) == [("secret", h)], t
    for t in (f"see commit {h} of it", "the token of 5 coins", f"https://example.org/a/{h}", "secret = 5", "no token here", ""):
        assert found(t) == [], t
    assert found(f'mail a.b@c.org, token = "{h}"') == [("email", "a.b@c.org"), ("secret", h)]


def test_pii_table(spark, crf):
    text = "Mail a.b@c.org or call (555) 123-4567, ip 10.0.0.1, é card 4111 1111 1111 1111."
    df = docs(spark, [(1, text), (2, None), (3, ""), (4, "no data here"), (4, "no data here"), (5, "9" * 200_000), (None, "x" * 50_000 + " a@b.de")], clash=True)
    got = pii.pii(df).collect()
    r = got[0]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 0)
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text))
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r["spans"].split(","))
    assert any(s.startswith("phone:") for s in r["spans"].split(","))
    assert [x["spans"] for x in got[1:5]] == ["", "", "", ""] and got[6]["n_email"] == 1 and got[6]["doc_id"] is None
    assert pii.pii(df.limit(0)).count() == 0
