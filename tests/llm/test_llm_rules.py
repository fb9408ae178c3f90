"""Cases that the given tables don't hold: unequal samples, rare scripts, other layouts, the query functions as registered."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stowage.llm import common, decontaminate, html_extract, language_id, near_dedup, pii, queries, url_filter

from .test_llm_operators import docs, edits, plain_near, plain_spans, words
from .test_llm_sql import DIR

held = pytest.mark.skipif(not __import__("os").path.isdir(DIR), reason="no test tables")


# --- languages


def speaker(letters, seed):
    r = random.Random(seed)
    known = ["".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(150)]
    return lambda n: " ".join(r.choice(known) for _ in range(n))


@pytest.mark.parametrize("chars", [12_000, 2000, 300])
def test_a_language_with_little_labelled_text_wins_its_own_texts(chars):
    a, b = speaker("abcdefgh", 1), speaker("efghijkl", 2)
    m = language_id.LanguageModel.fit({"a": a(5000)[:chars], "b": b(5000)[:12_000]})
    for lang, speak in (("a", a), ("b", b)):
        assert np.mean([x == lang for x in m.predict([speak(60) for _ in range(100)])[0]]) >= 0.95


def test_scripts_of_many_letters_keep_apart():
    r = random.Random(3)
    text = lambda first: "".join(chr(first + r.randrange(2000)) for _ in range(3000))
    zh, ja = text(0x4E00), text(0x4E00 + 2000)
    m = language_id.LanguageModel.fit({"ja": ja, "zh": zh})
    assert m.predict([zh[100:200], ja[50:150], "你" * 5])[0][:2] == ["zh", "ja"]


def test_phrases_of_long_texts_are_cut_at_gaps():
    a = speaker("abcdefgh", 4)
    m = language_id.LanguageModel.fit({"a": a(2000)})
    t = a(3000)
    f, n = m.phrases([t, "", "x" * 5000, t[:100]])
    assert n.tolist() == [len(t), 0, 5000, 100] and f[2, 0] == 5000  # a letter of no sample is a phrase
    alone = [m.phrases([x])[0][0, 0] for x in (t, "x" * 5000, t[:100])]
    assert alone == f[[0, 2, 3], 0].tolist()
    assert abs(f[0, 0] / n[0] / m.own[0] - 1) < 0.35  # its own text needs about what the folds of its sample need


def test_samples_with_null_and_repeated_ids(spark):
    a, b = speaker("abcdefgh", 5), speaker("efghijkl", 6)
    rows = [(None, a(30), "a") for _ in range(30)] + [(7, b(30), "b") for _ in range(500)] + [(7, None, "b"), (8, " ", "c"), (9, a(5), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one, two = language_id.train(df), language_id.train(df.repartition(7))
    assert one.languages == ["a", "b"] and all((x == y).all() for x, y in zip(one.tables, two.tables, strict=True))
    assert one.predict([a(40), b(40)])[0] == ["a", "b"]


def test_the_language_stage_uses_its_prediction(spark, tmp_path):
    a, b, q = speaker("abcdefgh", 7), speaker("efghijkl", 8), speaker("wxyz", 9)
    rows = [(i, (a if i % 2 else b)(60), "a" if i % 2 else "b") for i in range(60)] + [(100, q(60), None), (101, a(60), None), (102, "αβγδ εζηθ " * 30, None), (103, None, "a"), (104, "a", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_languages(spark, df, str(tmp_path)).collect()}
    assert set(got) == {*range(60), 101, 104} and got[101] == "a" and all(got[i] == ("a" if i % 2 else "b") for i in range(60))
    wrong = language_id.LanguageModel.fit({"q": q(500)})
    assert {r["doc_id"] for r in language_id.keep_known(df, wrong).collect()} == {100, 104}  # 104 is too short to tell
    assert language_id.keep_known(df, language_id.LanguageModel.fit({})).count() == 64  # nothing learned: only the null goes


@held
def test_held_out_accuracy_as_registered(spark):
    got = queries.QUERIES["op4_language_id"](spark, DIR).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got) and len(got) == len(lang)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean(right) >= 0.97


# --- decontamination


def brute(texts, items):
    """{item: edits} of every text, the plain way."""
    word = lambda t: "".join(c.lower() if ord(c) > 127 or c.isalnum() else " " for c in t or "").split()
    out = []
    for t in texts:
        w, found = word(t), {}
        for i, item in items:
            a = word(item)
            if a and (e := edits(a, w)) <= (int(0.2 * len(a)) if len(a) >= 7 else 0):
                found[i] = e
        out.append(found)
    return out


@pytest.mark.parametrize("n", [10, 20, 50, 64, 65, 100, 200])
def test_recall_at_the_limit_of_edits(n):
    """All candidates come from LSH keys; at exactly 20 % edits at least 0.9 of the items are found, of each kind."""
    r, e, kinds = random.Random(n), int(0.2 * n), ("delete", "insert", "replace", "spread")
    items = [[f"i{k}x{j}" for j in range(n)] for k in range(40)]
    table = decontaminate.Items.of(list(range(40)), [" ".join(i) for i in items])
    for kind in kinds:
        texts = []
        for item in items:
            body = list(item)
            places = [5 * j + 2 for j in range(e)] if kind == "spread" else sorted(r.sample(range(n), e))
            for k in reversed(places):
                body[k:k + (kind != "insert")] = [] if kind == "delete" else [f"n{r.randrange(10**6)}"]
            texts.append(" ".join(words(20, k) + body + words(20, k + 1)))
        got = decontaminate.find(pa.array(texts), table)
        assert sum(k in g and g[k] <= e for k, g in enumerate(got)) >= 36, kind


def test_without_keys_nothing_is_found(monkeypatch):
    items = [" ".join(words(30, k)) for k in range(5)]
    table = decontaminate.Items.of(list(range(5)), items)
    assert [set(g) for g in decontaminate.find(pa.array(items), table)] == [{k} for k in range(5)]
    table.keys = []
    assert decontaminate.find(pa.array(items), table) == [{}] * 5


def test_runs_that_many_items_share(monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    items = ["what is the best answer to the question about " + " ".join(words(k % 9 + 4, k)) for k in range(300)]
    table = decontaminate.Items.of(list(range(300)), items)
    texts = [f"{' '.join(words(30, 1000 + k))} {items[k]}" for k in range(0, 300, 10)] + ["what is the best answer to the question about nothing at all " * 50]
    got, want = decontaminate.find(pa.array(texts), table), brute(texts, list(enumerate(items)))
    assert all(set(g) <= set(w) for g, w in zip(got, want, strict=True)) and all(10 * k in g for k, g in enumerate(got[:-1]))
    assert sum(len(g) for g in got) >= 0.9 * sum(len(w) for w in want)


def test_rows_keep_apart_over_several_passes(spark, monkeypatch):
    a, b, c = (" ".join(words(20, k)) for k in range(3))
    df = docs(spark, [(None, a), (None, "nothing here"), (7, b), (7, c)])
    bench = spark.createDataFrame([(0, a), (1, b), (2, c)], "item_id bigint, text string")
    want = sorted((tuple(r) for r in decontaminate.contamination(df, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "ITEMS", 1)
    assert sorted((tuple(r) for r in decontaminate.contamination(df, bench).collect()), key=str) == want and len(want) == 4
    assert [r["doc_id"] for r in decontaminate.keep_clean(df, bench).collect()] == [None]


@held
def test_decontamination_as_registered(spark):
    got = {r["doc_id"]: r["items"] for r in queries.QUERIES["op8_decontaminate"](spark, DIR).collect()}
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    short = [r for r in rows if r["text"] and len(r["text"]) < 3000]
    want = {r["doc_id"]: sorted(w) for r, w in zip(short, brute([r["text"] for r in short], [(i["item_id"], i["text"]) for i in items]), strict=True)}
    assert len(got) == len(rows) and {i: got[i] for i in want} == want


# --- near duplicates


def test_likely_clusters_of_few_links_are_taken_apart(spark, monkeypatch):
    """Half of each text is common to all, so sketches look alike, but few texts link."""
    r = random.Random(21)
    common_ = [f"c{k}" for k in range(120)]
    rows = []
    for i in range(150):
        t = [*common_, *(f"u{i}x{k}" for k in range(50))]
        rows.append((i, " ".join(t)))
        if i % 15 == 0:
            rows.append((1000 + i, " ".join(w if k != 140 else f"e{r.random()}" for k, w in enumerate(t))))
    monkeypatch.setattr(near_dedup, "GROUP", 16)
    monkeypatch.setattr(near_dedup, "NODE", 16)
    monkeypatch.setattr(near_dedup, "PARTS", 1)
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == plain_near(rows)


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    base = words(400, 5, 10**6)
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(30)]
    monkeypatch.setattr(near_dedup, "BYTES", 8000)
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {x["component_id"] for x in got} == {0}


def test_near_copies_make_stars_once_and_not_in_every_tree(spark, monkeypatch):
    base, made, by_block = words(300, 5, 10**6), [], near_dedup._by_block
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(120)]

    def counted(session, pairs, near):
        out = near_dedup.written(by_block(session, pairs, near), "counted")
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_by_block", counted)
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {x["component_id"] for x in got} == {0} and sum(made) < 4 * len(rows)  # links of full sets included; a star in each of 14 trees is 1600 rows


@held
def test_near_dedup_as_registered_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op9_near_dedup"](spark, DIR).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == plain_near(rows)


# --- addresses


def test_registered_domains(spark):
    want = {"www.example.com": ("example.com", "com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "10.1.2.3:80": ("10.1.2.3", "10.1.2.3"), "x.org:8080": ("x.org", "org"),
            "me@x.org": ("x.org", "org"), "[::1]:80": ("[::1]", "[::1]"), "x.org.": ("x.org", "org"), "local": ("local", "local"), "": ("", ""), "com.de": ("com.de", "de")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    d, s = url_filter.registered(F.col("host"))
    got = {r[0]: (r[1], r[2]) for r in df.select("host", d, s).collect()}
    assert got == want | {"co.uk": ("co.uk", "co.uk"), "com.de": got["com.de"]}


def test_hosts_of_a_bad_domain_are_blocked_by_any_port(spark):
    pages = spark.createDataFrame([(1, "http://new.bad.co.uk:8080/"), (2, "http://other.co.uk/"), (3, "http://bad.co.uk/")], "page_id bigint, url string")
    outcomes = spark.createDataFrame([("bad.co.uk", 1)] * 40 + [("fine.co.uk", 0)] * 200 + [(None, 1)], "host string, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, outcomes).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


# --- pages


HAND = [
    ("""<html><body><div id=top class="site-header"><a href=/>Paper</a> | <a href=/n>News</a></div><div class="cols"><div class="sidebar"><ul><li><a href=1>One link</a><li><a href=2>Two links</a></ul></div>
<div class="post-body"><h2>A day at the river</h2><p>We walked for hours along the water, and saw nobody, which was the point of it all.</p><p>In the evening it rained, so we went home, tired, wet and happy with the day.</p></div></div>
<div class="comments"><p>Nice text!</p></div><footer>Copyright</footer></body></html>""",
     "A day at the river\nWe walked for hours along the water, and saw nobody, which was the point of it all.\nIn the evening it rained, so we went home, tired, wet and happy with the day."),
    ("""<nav><a href=a>Home</a><a href=b>About</a></nav><main><h1>Title</h1><p>First paragraph of the article, with enough words to be read as text, and a comma.<p>Second paragraph, which is as long as the first one, or nearly so, in words.</main>
<form><p>Subscribe</p><input></form>""",
     "Title\nFirst paragraph of the article, with enough words to be read as text, and a comma.\nSecond paragraph, which is as long as the first one, or nearly so, in words."),
]


@pytest.mark.parametrize("page,want", HAND)
def test_pages_of_other_layouts(page, want):
    assert html_extract.extract([page], html_extract.trained()) == [want]


def test_elements_without_an_end():
    text = "Some words of an article that is long enough, with a comma, to be kept."
    for before in ("<button>Menu", "<select><option>a", "<svg><path d=1>", "<noscript>", "<template>"):
        page = f"<body>{before}<article><p>{text}</p><p>{text}</p></article>"
        assert html_extract.extract([page], html_extract.trained())[0].endswith(f"{text}\n{text}"), before
    for whole in ("<button>Menu</button>", "<svg><g><text>x</text></g></svg>", "<noscript><p>turn on</p></noscript>", "<template><div>t</div></template>", "<script/>var x = '<p>no</p>';</script>"):
        assert html_extract.extract([f"<body><article>{whole}<p>{text}</p><p>{text}</p></article>"], html_extract.trained()) == [f"{text}\n{text}"], whole


# --- personal data


def test_long_tokens_are_read_whole():
    crf = pii.trained()
    plain, late = "x" * 300, "x" * 300 + "@y.de"
    assert set(pii.features(late)) != set(pii.features(plain)) and "at=True" in pii.features(late)
    assert pii.features("ab" * 200 + "[at]c.de")[-1] != pii.features("ab" * 200)[-1] and len(crf.scores(late)) == len(pii.LABELS)


@held
def test_patterns_as_registered(spark):
    import hashlib

    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op10_pii"](spark, DIR).collect():
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(rows[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r["spans"].split(","))


# --- shared helpers


def test_written_tables_are_deleted(spark):
    import os

    path = common.shared_dir(spark)
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    out = near_dedup.near_duplicates(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None)]))
    left = set(os.listdir(path)) - before
    assert len(left) == 1 and out.count() == 3


def test_hot_keys_have_an_absolute_bound(spark):
    df = spark.range(5000).selectExpr("id % 50 AS k")
    assert common.hot_keys(df, ["k"], share=10, least=10).count() == 0
    assert common.hot_keys(df, ["k"], share=10, least=10, most=99).count() == 50
    small = spark.range(50).selectExpr("id AS k", "id * 2 AS v")
    for few in (10, 1000):
        common.FEW, old = few, common.FEW
        try:
            got = common.join_hot(df, small, ["k"], common.hot_keys(df, ["k"], share=10, least=10, most=99))
            assert got.where("v = 2 * k").count() == 5000
        finally:
            common.FEW = old
