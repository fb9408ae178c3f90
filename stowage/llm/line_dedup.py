"""Line dedup: drop lines that many documents share, keeping them in one document.

Line keys are hashed to 128 bits, range-partitioned by hash and sorted by document and position; a window streams over
each run of equal hashes, marks all but the first document, and what leaves the operator is a bitmap a document (64
lines a word, words without a dropped line left out), not text.  Keys of more than common.HOT_ROWS lines, or of over
1/1000 of all lines, do not go through the range partitioning: they are counted with map-side sums, and their lines meet
that one row a key by broadcast while those keys are few, by a merge join beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, SPACE, ascii_lower, hot_keys, is_few, n_parts, scratched, sided, written


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id and _tv (hash of the text, so that rows which share an id but not a text keep apart), both never null."""
    return docs.withColumns({
        "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)),
        "_tv": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
        "_lines": F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1),
    })


@scratched
def shared_line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                        min_docs: int = 3) -> DataFrame:
    """One row for each document that loses a line: _id, _tv, keep (map from word number to the 64 keep bits of lines
    64 * word .. 64 * word + 63; a word that is missing keeps all its lines).

    A line's key is the line trimmed of white space, A-Z lower-cased.  Keys of at least min_chars code points found
    under at least min_docs different ids lose all their lines but those of the largest id.  Null text is one empty
    line; a null id is the smallest id; rows that share an id are one document for the count, and where they tie on the
    largest id all keep their lines.  Empty input gives no rows; other columns are not looked at.
    """
    line = F.btrim(F.col("_line"), F.lit(SPACE))
    lines = (
        _keyed(docs.select(id_col, text_col), id_col, text_col)
        .select("_id", "_tv", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_tv", "_pos", line.alias("_key")).where(F.length("_key") >= min_chars)
        .withColumn("_key", ascii_lower(F.col("_key")))
        .select("_id", "_tv", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    )
    lines = written(lines, "lines")
    keys = ["_h1", "_h2"]
    hot_ones = hot_keys(lines, keys)
    small = is_few(hot_ones)
    few = sided(hot_ones, small)

    run = W.partitionBy(*keys).orderBy(F.col("_id").desc())
    cold = (
        lines.join(few, keys, "left_anti").repartitionByRange(n_parts(docs.sparkSession), *keys)
        .sortWithinPartitions("_h1", "_h2", F.col("_id").desc(), "_pos")
        .withColumn("_rank", F.dense_rank().over(run))
        .withColumn("_docs", F.max("_rank").over(W.partitionBy(*keys)))
        .where((F.col("_docs") >= min_docs) & (F.col("_rank") > 1))
        .select("_id", "_tv", "_pos")
    )
    hot = lines.join(few, keys, "left_semi")
    most = (
        hot.groupBy(*keys, "_id").agg(F.lit(1).alias("_one")).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_first"))
        .where(F.col("_docs") >= min_docs).select(*keys, "_first")
    )
    hot = hot.join(sided(most, small), keys).where(F.col("_id") < F.col("_first")).select("_id", "_tv", "_pos")

    word = F.col("_pos").cast("long") / 64
    return (
        cold.unionByName(hot)
        .groupBy("_id", "_tv", F.floor(word).alias("_word"))
        .agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, cast(_pos % 64 as int))"))).alias("_bits"))
        .groupBy("_id", "_tv").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_keep"))
    )


def apply_line_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; null text gives one line, kept, and the empty kept_text.  Nothing
    bounds the number of bitmaps, so texts are shuffled to them, by one plan at every size."""
    held = "shiftrightunsigned(coalesce(element_at(_keep, cast(floor(i / 64) as bigint)), -1L), i % 64) & 1L = 1L"
    kept = F.when(F.col("_keep").isNull(), F.col("_lines")).otherwise(F.expr(f"filter(_lines, (x, i) -> {held})"))
    joined = _keyed(docs, id_col, text_col).join(bitmaps.hint("merge"), ["_id", "_tv"], "left").withColumn("_kept", kept)
    return joined.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": (F.size("_lines") - F.size("_kept")).cast("long"),
        "kept_text": F.array_join("_kept", "\n"),
    }).drop("_id", "_tv", "_lines", "_keep", "_kept")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
               min_docs: int = 3) -> DataFrame:
    """The columns of docs, and n_lines, n_dropped, kept_text.  See shared_line_bitmaps for nulls, ties and repeats;
    columns of docs called n_lines, n_dropped or kept_text are replaced."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text", "_id", "_tv", "_lines", "_keep", "_kept")
    return apply_line_bitmaps(docs, shared_line_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.holder AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
