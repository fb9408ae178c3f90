"""The pipeline on a small fixture, against a plain Python version of its five stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stowage.llm import mixing

from .test_llm_operators import edits, plain_lines, plain_near


@pytest.fixture
def corpus(spark, tmp_path):
    r = random.Random(5)
    speak = {"en": "the of and to in that is was for with house garden water people".split(), "de": "der die das und ist nicht ein mit haus garten wasser leute".split()}
    text = lambda lang, n: " ".join(r.choice(speak[lang]) + r.choice(["", "", "er", "ing", "en", "st"]) for _ in range(n))
    shared = ["this line is shared by many documents", "noch eine zeile die viele dokumente teilen"]
    item = " ".join(f"b{r.randrange(500)}" for _ in range(30))
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        t = "\n".join([text(lang, 40), *r.sample(shared, r.randrange(3)), text(lang, 20)])
        rows.append([i, t, lang, f"s{i % 4}" if i % 9 else None, len(t)])
    rows[10][1] = rows[11][1]
    rows[12][1] = rows[13][1] + " more"
    rows[20][1] += " " + item
    rows[21][1] += "\n" + " ".join(w if k != 7 else "changed" for k, w in enumerate(item.split()))
    rows[30][1], rows[31][1], rows[32][1] = None, "", "123 456 !!"
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"kept": F.lit("x"), "n_lines": F.lit(1)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, "zzz " * 20)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, item


def test_pipeline_against_plain_python(spark, corpus):
    path, rows, item = corpus
    kept = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = [(i, t) for i, _, _, t in plain_lines(kept)]
    kept = [(i, t) for i, t in kept if i in {x for x, _, c in plain_near(kept) if x == c}]
    kept = [(i, t) for i, t in kept if edits(item.split(), t.split()) > int(0.2 * 30)]
    source = {r[0]: r[3] for r in rows}
    size = {i: len(t.split()) for i, t in kept}
    total = {}
    for i in size:
        total[source[i]] = total.get(source[i], 0) + size[i]
    goal = mixing.targets(total)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert {i: r["size"] for i, r in got.items()} == size
    assert all(abs(r["target"] - goal[source[i]]) < 1e-5 and r["source_size"] == total[source[i]] for i, r in got.items())
    for s in total:
        assert abs(sum(r["taken"] for i, r in got.items() if source[i] == s) - goal[s]) <= 1


def test_stages_keep_the_columns_and_take_empty_tables(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).columns == docs.columns
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "n_lines"] and docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_rows_with_a_null_or_shared_id_are_documents_of_their_own(spark, tmp_path):
    r = random.Random(12)
    a, b, c, d, e = (" ".join(f"{k}{r.randrange(500)}" for _ in range(60)) for k in "abcde")
    rows = [(None, a), (None, b), (None, c), (5, a + " more"), (7, b + " more"), (9, d), (9, e), (9, d), (4, e + " more"), (2, ""), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = corpus_pipeline.dedup_documents(spark, df, str(tmp_path))
    want = [(None, a), (None, b), (None, c), (9, d), (4, e + " more"), (2, ""), (2, "")]
    assert got.columns == df.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted(want, key=str)
