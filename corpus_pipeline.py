"""From raw documents to a weighted mix, in five stages: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import language_id, line_dedup, mixing, near_dedup
from stowage.llm import decontaminate as decontamination
from stowage.llm.common import NO_ID, python_side, scratched, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or is far from every language that the labelled ones teach; all
    others stay, with the predicted language as lang."""
    python_side(spark)
    model = language_id.train(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    return language_id.keep_known(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that they share with a later document; n_chars follows.  No document goes."""
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))  # no column clashes with the operator's
    at = {n: f"_c{i}" for i, n in enumerate(names)}
    out = line_dedup.line_dedup(plain, at["doc_id"], at["text"])
    cols = {"text": F.when(F.col(at["text"]).isNotNull(), F.col("kept_text")), "n_chars": F.coalesce(F.length("kept_text"), F.lit(0)).cast("long")}
    return out.select(*(cols.get(n, F.col(at[n])).alias(n) for n in names))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays (a null one is the smallest).  Rows are
    the documents here: where an id is null or repeats, rows are grouped by a number of their own, so rows that share an
    id but no text all stay."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    shared = docs.groupBy(key.alias("_id")).count().where((F.col("count") > 1) | (F.col("_id") == NO_ID))
    if shared.isEmpty():
        found = written(near_dedup.near_duplicates(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_id"), "kept"), "near")
        return docs.join(found.where("not kept").select("_id").hint("merge"), F.col("doc_id") == F.col("_id"), "left_anti")
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # written, so a row keeps its number
    found = near_dedup.near_duplicates(rows.select("_row", "text"), "_row").select("_row", "component_id")
    found = written(rows.select("_row", key.alias("_id")).join(found, "_row"), "near")
    first = found.groupBy("component_id").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_row"))
    return rows.join(first.select("_row").hint("merge"), "_row", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken, source."""
    return mixing.mix_single(docs.select("doc_id", "text", "source"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Stages 1, 3 and 4 have no SQL form; tests/llm holds the whole run against a plain Python version.
ORACLE_SQL = None


@scratched
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables between the stages are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
