"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources.  They are aggregated by membership pattern (the sorted set of their sources);
a flow network (source of flow -> patterns -> quotas -> sink) routes token capacity to the quotas, where a pattern's
first copy costs 1 a token and its second 3, so repetition is used only where first copies run out.  The flow is solved
on the driver: its size is the number of distinct patterns, not of documents.  Documents of a pattern are then taken in
the order of a seeded hash; a 4096-bucket histogram finds the bucket in which each pattern's flow ends, and only that
bucket is sorted.  The document on the border is taken in part, so a pattern's flow is met to the word.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: dict, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, total: int | None = None) -> dict:
    """sizes: words by source; total: all words, where documents of several sources count once.  Sources by code point, null last, get the weights in turn; a target stops at most *
    size, and the excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free = share * (sum(sizes.values()) if total is None else total), [s for s in order if sizes[s] > 0]
    out = dict.fromkeys(order, 0.0)
    while free:
        unit = left / sum(w[s] for s in free)
        full = [s for s in free if w[s] * unit > most * sizes[s]]
        if not full:
            out |= {s: w[s] * unit for s in free}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def min_cost_flow(patterns: dict, quotas: dict, copies: int = 2) -> dict:
    """patterns: {tuple of sources: words}; quotas: {source: words}.  Successive shortest paths with potentials;
    returns {(pattern, source): words}.  Copy c of a pattern costs 2 c - 1 a word (convex)."""
    ids: dict = {}
    node = lambda x: ids.setdefault(x, len(ids))
    s, t = node("s"), node("t")
    graph: list[list[list]] = [[], []]

    def edge(a, b, cap, cost):
        while len(graph) < len(ids):
            graph.append([])
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    arcs = {}
    for p, size in patterns.items():
        for c in range(1, copies + 1):
            edge(s, node(("p", p)), size, 2 * c - 1)
        for src in p:
            a, b = node(("p", p)), node(("q", src))
            edge(a, b, size * copies, 0)
            arcs[p, src] = (a, len(graph[a]) - 1)
    for src, q in quotas.items():
        edge(node(("q", src)), t, q, 0)
    while len(graph) < len(ids):
        graph.append([])
    high = [0] * len(graph)
    while True:
        dist, came, heap = [float("inf")] * len(graph), {}, [(0, s)]
        dist[s] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for i, (v, cap, cost, _) in enumerate(graph[u]):
                if cap > 0 and (nd := d + cost + high[u] - high[v]) < dist[v]:
                    dist[v], came[v] = nd, (u, i)
                    heapq.heappush(heap, (nd, v))
        if dist[t] == float("inf"):
            break
        high = [h + (d if d < float("inf") else 0) for h, d in zip(high, dist, strict=True)]
        flow, v = float("inf"), t
        while v != s:
            u, i = came[v]
            flow, v = min(flow, graph[u][i][1]), u
        v = t
        while v != s:
            u, i = came[v]
            graph[u][i][1] -= flow
            graph[v][graph[u][i][3]][1] += flow
            v = u
    return {k: patterns[k[0]] * copies - graph[a][i][1] for k, (a, i) in arcs.items()}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "sources",
        seed: str = "mix", share: float = 1.5, most: int = 2) -> DataFrame:
    """docs: id, text, and an array of sources (one null stands for the null source).  Returns id, size, sources,
    targets (of those sources, in the array's order), taken (words the mix takes of it, repeats counted).

    Size: runs of characters that are not white space; null text has none.  A null id counts as the smallest; rows that
    share an id are ordered by size and taken together or in turn; a null or empty array is the null source.  The same
    rows and seed give the same mix.  No rows give no rows.
    """
    lone = F.array(F.lit(None).cast("string"))
    src = F.when(F.coalesce(F.size(sources_col), F.lit(0)) > 0, F.array_sort(F.array_distinct(sources_col))).otherwise(lone)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), src.alias("sources"))
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    rows = written(rows.withColumn("_rank", rank).withColumn("_bucket", F.substring("_rank", 1, 3)), "sizes")
    spark = docs.sparkSession
    patterns = {tuple(r["sources"]): r["n"] for r in rows.groupBy("sources").agg(F.sum("size").alias("n")).collect()}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, share, most, total=sum(patterns.values()))
    flow = min_cost_flow(patterns, {s: int(g + 0.5) for s, g in goal.items()}, most)
    taken = {p: sum(flow[p, s] for s in p) for p in patterns}

    few = spark.createDataFrame(
        [(list(p), taken[p] // n if n else 0, taken[p] % n if n else 0, [float(goal[s]) for s in p]) for p, n in patterns.items()],
        "sources array<string>, _base long, _rest long, targets array<double>")
    few = few.withColumn("_p", F.xxhash64("sources"))  # the patterns were just counted: one row each
    rows = rows.withColumn("_p", F.xxhash64("sources"))
    hist = rows.groupBy("_p", "_bucket").agg(F.sum("size").alias("_n")).withColumn(
        "_before", F.sum("_n").over(W.partitionBy("_p").orderBy("_bucket")) - F.col("_n"))
    border = hist.join(F.broadcast(few.select("_p", "_rest")), "_p").where(
        (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_n"))).select("_p", F.col("_bucket").alias("_edge"), "_before")
    rows = rows.join(F.broadcast(few.drop("sources")), "_p").join(F.broadcast(written(border, "border")), "_p", "left")
    # a pattern whose rest is 0 ends before its first bucket with words; no border means that nothing is left over
    inside = (F.col("_bucket") == F.col("_edge")) & (F.col("_rest") > 0)
    ends = F.sum("size").over(W.partitionBy("_p").orderBy("_rank", F.coalesce("_id", F.lit(NO_ID)), "size").rowsBetween(W.unboundedPreceding, 0))
    edge = rows.where(F.coalesce(inside, F.lit(False))).withColumn("_left", F.col("_rest") - F.col("_before") - ends + F.col("size"))
    edge = edge.withColumn("_more", F.greatest(F.lit(0), F.least("size", "_left"))).drop("_left")
    rest = rows.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "_more", F.when(F.coalesce((F.col("_rest") > 0) & (F.col("_bucket") < F.col("_edge")), F.lit(False)), F.col("size")).otherwise(F.lit(0).cast("long")))
    return rest.unionByName(edge).select(
        F.col("_id").alias(id_col), "size", "sources", "targets",
        (F.col("_base") * F.col("size") + F.col("_more")).cast("long").alias("taken"))


def mix_single(docs: DataFrame) -> DataFrame:
    """mix() for documents of one source: doc_id, size, source_size, target, taken, source."""
    out = mix(docs.select("doc_id", "text", F.array("source").alias("sources")))
    sizes = out.groupBy(F.col("sources")[0].alias("source")).agg(F.sum("size").alias("source_size"))
    out = out.withColumn("source", F.col("sources")[0]).withColumn("target", F.round(F.col("targets")[0], 6))
    sizes = sizes.withColumnRenamed("source", "_source")  # one row a source, as the flow network has
    return out.join(F.broadcast(sizes), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_single(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def mix_sql(documents: str = "documents") -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS rank
  FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM w),
c AS (
  SELECT *, (1.5 * sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free
  FROM o),
u AS (SELECT arg_min((total - used) / free, k) FILTER (WHERE (total - used) / free <= 2.0 * source_size / weight) AS unit FROM c),
t AS (SELECT c.source, c.source_size, least(2.0 * c.source_size, c.weight * u.unit)::DOUBLE AS target FROM c, u),
q AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
         (sum(size) OVER (PARTITION BY d.source ORDER BY rank, coalesce(doc_id, -9223372036854775808), size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CASE WHEN source_size = 0 THEN 0
            ELSE quota // source_size * size + greatest(0, least(size, quota % source_size - upto + size)) END::BIGINT AS taken,
       source
FROM q
"""


OP5_SQL = mix_sql()
