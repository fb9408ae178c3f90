"""Chat formatting: reply trees to training conversations.

Iterative self-joins double every message's pointer to an ancestor until it passes the root, so paths of any depth take
log2(depth) joins; each leaf then stands for one root-to-leaf path with its score.  The best `top` paths of a
conversation are chosen, their messages found by walking the stored pointer tables back, and each path becomes one
formatted conversation.

Template: every turn is `<s>[TAG]text</s>`, TAG being INST (user), ASST (assistant), SYS (system), NONE (null) or
ROLE:hex for any other role.  Inside texts a backslash is doubled and `<` or `[` gets a backslash after it, so no
control string can stand in a text and the escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratched, written

TAGS = {"user": "INST", "assistant": "ASST", "system": "SYS"}


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "<\\"), ("[", "[\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\|\\(\\)", "$1$2")


def _tag(role: Column) -> Column:
    out = F.when(role.isNull(), "NONE")
    for k, v in TAGS.items():
        out = out.when(role == k, v)
    return out.otherwise(F.concat(F.lit("ROLE:"), F.hex(role)))


def _role(tag: Column) -> Column:
    out = F.when(tag == "NONE", F.lit(None).cast("string"))
    for k, v in TAGS.items():
        out = out.when(tag == v, k)
    return out.otherwise(F.decode(F.unhex(F.substring(tag, 6, 1 << 30)), "UTF-8"))


@scratched
def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """messages: conv_id, msg_id (unique in its conversation), parent_id (null at a root), score.  Returns a row for
    each message of each chosen path: conv_id, leaf_id, msg_id, depth (0 at the root), path_score, path_rank (1 is best).

    Paths rank by summed score (null counts 0), then by depth, longest first, then by smallest leaf.  A parent that does
    not exist makes its child a root; messages on a cycle reach no root and belong to no path.  Null conv_id is a
    conversation of its own.  No rows give no rows.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    m = written(messages.select(key.alias("_c"), "conv_id", "msg_id", "parent_id",
                                F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("_s")), "msgs")
    real = m.select("_c", F.col("msg_id").alias("up"), F.lit(True).alias("_real"))
    step = (m.withColumn("up", F.col("parent_id")).join(real, ["_c", "up"], "left")
            .select("_c", "msg_id", F.when(F.col("_real"), F.col("up")).alias("up"), F.col("_s").alias("sum"),
                    F.lit(1).cast("long").alias("hops")))
    n = max(1, m.count())
    tables, parts, step = [], [], written(step, "jump")
    # After k joins a pointer is 2^k messages up, so paths of any length end within log2(n) + 1 joins; a message whose
    # pointer has passed the root takes no part in further ones.
    while True:
        parts.append(step.where(F.col("up").isNull()))
        open_ = step.where(F.col("up").isNotNull())
        if 2 ** len(tables) > n or open_.isEmpty():
            break
        tables.append(open_.select("_c", "msg_id", "up"))
        far = open_
        for p in parts:
            far = far.unionByName(p)
        far = far.select("_c", F.col("msg_id").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("hops").alias("_hops"))
        step = written(open_.join(far, ["_c", "up"]).select(
            "_c", "msg_id", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("hops") + F.col("_hops")).alias("hops")), "jump")
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    parents = m.where(F.col("parent_id").isNotNull()).select("_c", F.col("parent_id").alias("msg_id")).distinct()
    leaves = done.join(parents, ["_c", "msg_id"], "left_anti")
    best = F.struct(F.col("sum"), F.col("hops"), (-F.col("msg_id")).alias("_neg"))
    if top == 1:  # one partial aggregate: a conversation with very many branches needs no sort
        chosen = leaves.groupBy("_c").agg(F.max(best).alias("b")).select(
            "_c", (-F.col("b._neg")).alias("leaf_id"), F.col("b.sum").alias("path_score"), F.lit(1).alias("path_rank"))
    else:
        w = W.partitionBy("_c").orderBy(F.desc("sum"), F.desc("hops"), "msg_id")
        chosen = leaves.withColumn("path_rank", F.row_number().over(w)).where(F.col("path_rank") <= top).select(
            "_c", F.col("msg_id").alias("leaf_id"), F.col("sum").alias("path_score"), "path_rank")
    walk = chosen.withColumn("msg_id", F.col("leaf_id"))
    # far jumps first: what stands 2^k above each message found so far; only the last, short jumps meet many rows
    for t in reversed(tables):
        walk = (walk.join(t, ["_c", "msg_id"], "left")
                .withColumn("msg_id", F.explode(F.array_compact(F.array("msg_id", "up")))).drop("up"))
    depth = done.select("_c", "msg_id", (F.col("hops") - 1).alias("depth"))
    ids = m.select("_c", "msg_id", "conv_id")
    return walk.join(depth, ["_c", "msg_id"]).join(ids, ["_c", "msg_id"]).drop("_c")


def format_reply_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """messages: conv_id, msg_id, parent_id, role, text, score (other columns are ignored).  Returns a row for each
    chosen path: conv_id, leaf_id, path_rank, path_score, formatted, loss_spans (code point start and end, end
    exclusive, of each assistant text inside `formatted`, in order).  Null text is empty.  See reply_paths."""
    body = messages.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("_c"), "msg_id",
                           _tag(F.col("role")).alias("tag"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    paths = reply_paths(messages, top).withColumn("_c", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")))
    turns = paths.join(body, ["_c", "msg_id"])
    path = W.partitionBy("_c", "leaf_id").orderBy("depth")
    head = F.concat(F.lit("<s>["), F.col("tag"), F.lit("]"))
    piece = F.concat(head, F.col("body"), F.lit("</s>"))
    turns = turns.withColumn("_end", F.sum(F.length(piece).cast("long")).over(path)).withColumn(
        "_span", F.when(F.col("tag") == "ASST", F.struct((F.col("_end") - 4 - F.length("body")).alias("start"),
                                                         (F.col("_end") - 4).alias("end"))))
    rows = turns.select("_c", "leaf_id", "conv_id", "path_rank", "path_score", F.struct(F.col("depth"), piece.alias("piece"), "_span").alias("t"))
    whole = rows.groupBy("_c", "leaf_id").agg(
        F.first("conv_id").alias("conv_id"), F.first("path_rank").alias("path_rank"),
        F.first("path_score").alias("path_score"), F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", "leaf_id", "path_rank", "path_score",
                        F.array_join(F.col("t.piece"), "").alias("formatted"),
                        F.array_compact(F.col("t._span")).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, escapes undone."""
    pieces = F.filter(F.split(formatted, "</s>", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        _role(F.substring_index(F.substring(p, 5, 1 << 30), "]", 1)).alias("role"),
        unescape(F.substr(p, F.locate("]", p) + 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, escapes undone, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def linear_chains(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as reply trees without branches: every row answers the one before it by (turn, role,
    text); rows that tie on all three are repeated turns and stay."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.withColumn("msg_id", n.cast("long")).withColumn(
        "parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)).withColumn("score", F.lit(0.0))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text UNION ALL "
                    "SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    out = format_reply_trees(linear_chains(rows.unionByName(own)))
    turns, loss = read_back(F.col("formatted")), masked_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(
        F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("turns", turns).withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, CASE WHEN role IS NULL THEN 'NONE' WHEN role = 'user' THEN 'INST' WHEN role = 'assistant' THEN 'ASST'
                 WHEN role = 'system' THEN 'SYS' ELSE 'ROLE:' || hex(role) END AS tag,
         length(text) + 2 * 0 + length(text) - length(replace(text, '\', '')) + length(text)
           - length(replace(text, '<', '')) + length(text) - length(replace(text, '[', '')) AS body
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(9 + length(tag) + body)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
