"""Near-duplicate documents by a chosen-path set similarity join.

1. Each text becomes the set of its 5-word shingles (64-bit hashes).  Texts with the same set (128-bit digest of all of
   it) are one representative from here on.
2. TREES independent trees.  At the first level of a tree a document goes to the node of the token of its set that a hash
   of the tree puts first.  A node with at most NODE documents is compared exhaustively.  A larger one is dealt in blocks
   that all hold the same few pivots.  Documents that are not connected to its first pivot are compared with every block
   if there are at most NODE of them; if there are more, all documents of the node branch on, each by the tokens that
   BRANCH further hashes put first.  At level LEVELS they are compared however many there are: nothing is capped.  Comparison is by bottom-k sketches
   against a threshold well below the wanted similarity; it emits, for each node, a star a component, never all pairs.
   The first level of the FIRST trees is compared before all else; from there on what its stars connect is known, and a
   node emits only what joins known components, so copies make a star once and not in every tree and level.
   The stars' components are the candidate clusters.
3. Links are confirmed on the full sets of each cluster, recomputed from the whole texts: clusters of up to GROUP
   documents and BYTES of text in one go, larger ones in blocks with pivots, then every document outside the cluster's
   largest component against every block.  A cluster in which such documents would fill over PARTS blocks (much common
   text, few links) is first taken apart by the same trees on longer sketches with a higher threshold.  Two documents of
   a cluster are either compared on full sets or already connected by links.

Two sets with similarity s part in one tree, before a node that is compared, with probability 1 - s where nodes are small
at level 1, and 1 - s (1 - (1 - s)^BRANCH)^(l - 1) where all nodes are large down to level l.  With s = 0.75, 14 trees
and two branches all trees miss with 4e-9 at level 1, 4e-8 at level 2, 3e-7 at level 3 and 1.4e-6 at level 4, the
deepest: the case of a borderline copy in nodes that stay open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, hot_keys, is_few, join_hot, n_parts, python_side, scratched, sided, written
from .graph import connected_components, stars
from .shingles import mix, shingle_sets

TREES, LEVELS, BRANCH, NODE = 14, 4, 2, 256
#: Trees whose first level says what is known to be connected.
FIRST = 2
#: Documents and bytes of text that are compared at once on full sets; blocks that one cluster's rest may fill.
GROUP, BYTES, PARTS = 256, 16 << 20, 8
#: Values of a sketch, and the likeness below which two are no candidates: 5 standard errors below 0.75.
SKETCH, LOOKS = 64, 0.48
LONG_SKETCH, LONG_LOOKS = 512, 0.65
#: Hashes of a tree: one at its first level, BRANCH at each further one.
_EACH = 1 + BRANCH * (LEVELS - 1)
_SEEDS = mix(np.arange(101, 101 + TREES * _EACH, dtype=np.uint64)) | np.uint64(1)
_DIGEST, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _describe(batches, width: int = SKETCH):
    """id, number of shingles, two digests of the set, the first token of each hash, and the `width` smallest hashes."""
    for batch in batches:
        sets = shingle_sets(batch.column(1))
        n = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        full = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[full]
        d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        tokens = np.zeros((len(n), len(_SEEDS)), np.uint32)
        if len(full):
            d1[full] = np.add.reduceat(flat, starts)
            d2[full] = np.add.reduceat(mix(flat ^ _DIGEST), starts)
            for k, seed in enumerate(_SEEDS):
                tokens[full, k] = (np.minimum.reduceat(flat * seed, starts) >> np.uint64(32)).astype(np.uint32)
        sketch = [(s[:width] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(_SEEDS)), pa.array(tokens.ravel().view(np.int32))),
             pa.array(sketch, pa.binary())], names=["id", "n", "d1", "d2", "tokens", "sketch"])


DESCRIBED = "id long, n long, d1 long, d2 long, tokens array<int>, sketch binary"


def _roots(reps: DataFrame) -> DataFrame:
    """The node of each document at the first level of each tree: id, tokens, tree, node."""
    firsts = F.array(*(F.col("tokens")[k * _EACH] for k in range(TREES)))
    return reps.select("id", "tokens", F.posexplode(firsts).alias("tree", "_t")).select(
        "id", "tokens", "tree", F.xxhash64("tree", "_t").alias("node"))


def _branches(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes below those given, at a further level."""
    at = F.col("tree") * _EACH + 1 + BRANCH * (level - 1)
    next_ = F.array(*(F.get(F.col("tokens"), at + k) for k in range(BRANCH)))
    return nodes.select("id", "tokens", "tree", "node", F.posexplode(next_).alias("_b", "_t")).select(
        "id", "tokens", "tree", F.xxhash64("node", "_b", "_t").alias("node"))


def _alike(rows: list[bytes], known: list[int], width: int = SKETCH, looks: float = LOOKS) -> list[tuple[int, int]]:
    """Stars (position, smallest position of its component) of rows whose sketches look alike: by the share, of the
    `width` smallest values of two rows, that are in both; sets of up to `width` shingles are whole in their sketches.
    Rows that are connected already, by the component known of each or here, are not compared again."""
    _, first, of = np.unique(np.array(known, dtype=np.int64), return_index=True, return_inverse=True)
    label = first[of]
    if len(first) == 1:
        return [(int(i), int(c)) for i, c in enumerate(label) if i != c]
    values = [np.frombuffer(r, dtype=np.uint32) for r in rows]
    n, sizes = len(values), np.array([len(v) for v in values])
    every, where, held_by = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = held_by > 1  # other values are common to no two rows
    has = np.zeros((n, int(shared.sum())), dtype=np.float32)
    mine = shared[where]
    has[np.repeat(np.arange(n), sizes)[mine], (np.cumsum(shared) - 1)[where[mine]]] = 1
    every = every[shared]
    # the values up to the smaller of two last ones hold one of the sketches, so fewer common ones are too few
    maybe = has @ has.T >= looks * np.minimum(sizes[:, None], sizes[None, :])
    last = np.array([v[-1] if len(v) == width else 0xFFFFFFFF for v in values], dtype=np.uint32)
    for i in range(n - 1):
        js = i + 1 + np.flatnonzero(maybe[i, i + 1:] & (label[i + 1:] != label[i]))
        if not len(js):
            continue
        upto = np.minimum(last[i], last[js])  # values above are unknown in one of the two
        inside = np.arange(len(every)) < np.searchsorted(every, upto, side="right")[:, None]
        both = (has[js] * has[i] * inside).sum(axis=1)
        either = np.searchsorted(values[i], upto, side="right") - both
        either += np.array([np.searchsorted(values[j], u, side="right") for j, u in zip(js.tolist(), upto, strict=True)])
        joined = js[both >= looks * either]
        if len(joined):
            names = np.unique(np.append(label[joined], label[i]))
            label[np.isin(label, names)] = names[0]
    return [(int(i), int(c)) for i, c in enumerate(label) if i != c]


def groups(batches, key: str):
    """Rows of a sorted partition as one dict of column lists a key; only one key's rows are held."""
    held, now = None, None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held is not None and now == keys[a]:
                held.append(part)
            else:
                if held is not None:
                    yield pa.Table.from_batches(held)
                held, now = [part], keys[a]
    if held is not None:
        yield pa.Table.from_batches(held)


def _compare(batches, near):
    """For each node or block the stars that near(table) finds: a the smallest id of a component, b another one of it.  `far`
    rows are documents of a block with pivots that are not in the component of the first pivot.  Rows may say what component
    they are `known` to be in: a star then has one member of each."""
    cols: tuple[list, ...] = ([], [], [], [], [])
    for t in groups(batches, "key"):
        if t.num_rows < 2:
            continue
        t = t.sort_by("id")  # so the smallest position is the smallest id
        ids, pivots, node, big = t["id"].to_pylist(), t["pivot"].to_pylist(), t["node"][0].as_py(), t["big"][0].as_py()
        label = list(range(len(ids)))
        for i, c in near(t):
            label[i] = c
        # where the rest of a node meets it, what is connected without that rest was found before
        told = {c for p, c in zip(pivots, label, strict=True) if p < 0} if min(pivots) < 0 else set(label)
        known = t["known"].to_pylist() if "known" in t.schema.names else ids
        had = {(c, known[c]) for c in told}
        for i, c in enumerate(label):
            if c in told and (c, known[i]) not in had:
                had.add((c, known[i]))
                for col, x in zip(cols, (ids[c], ids[i], False, node, big), strict=True):
                    col.append(x)
        if max(pivots) > 0:
            home = {c for p, c in zip(pivots, label, strict=True) if p == 1}
            for i, (x, c) in enumerate(zip(ids, label, strict=True)):
                if c not in home and (i == 0 or ids[i - 1] != x):
                    for col, v in zip(cols, (x, x, True, node, big), strict=True):
                        col.append(v)
        if len(cols[0]) > 5000:
            yield _batch(cols)
            cols = ([], [], [], [], [])
    yield _batch(cols)


def _batch(cols):
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "far", "node", "big"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Exact: whether 100 * intersection >= percent * union of each two sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # a hash of one set is in no intersection
    owner, column = owner[shared], column[shared]
    common = np.zeros((n, n), dtype=np.int64)
    if len(column):
        column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
        step = 4096
        for lo in range(0, int(column[-1]) + 1, step):
            i, j = np.searchsorted(column, (lo, lo + step))
            has = np.zeros((n, step), dtype=np.float32)
            has[owner[i:j], column[i:j] - lo] = 1
            common += (has @ has.T).astype(np.int64)  # at most `step` each, so exact
    either = sizes[:, None] + sizes[None, :] - common
    return (100 * common >= percent * either) & (sizes[:, None] > 0) & (sizes[None, :] > 0)


def _by_block(spark, rows: DataFrame, near) -> DataFrame:
    schema = "a long, b long, far boolean, node long, big boolean"
    dealt = rows.repartition(n_parts(spark), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _compare(batches, near), schema)


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members: node, id; sizes: node, blocks, and pivots (their ids).  Rows (key, node, id, pivot): each member in a
    block of its node, and each pivot in every block, numbered from 1 (0: no pivot; -1, in _again: one of the rest)."""
    own = members.join(sizes, "node").select("node", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(0).alias("pivot"))
    every = sizes.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "node", F.posexplode(F.array_distinct("pivots")).alias("pivot", "id"), "block")
    return own.unionByName(every.select("node", "id", "block", (F.col("pivot") + 1).alias("pivot"))).select(
        F.xxhash64("node", "block").alias("key"), "node", "id", "pivot")


def _pivots(members: DataFrame, size: int, weight=None) -> DataFrame:
    """node, n, weight, blocks (of about `size` members and BYTES of weight), pivots: the members that each of four
    hashes puts first, by map-side minimums."""
    weight = F.lit(0).cast("long") if weight is None else weight
    return members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"), F.array(*(
        F.min_by("id", F.xxhash64(F.lit(k), "id")) for k in range(4))).alias("pivots")).withColumn(
        "blocks", F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("weight") / BYTES), F.lit(1)).cast("long"))


def _rest(far: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, n, m (documents of the node in `far`: node, id), blocks, and the parts in which those meet the blocks, about
    as many of them in a part as members in a block."""
    left = far.groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    return written(sizes.join(left, "node").select("node", "n", "m", "blocks", F.ceil(F.col("m") * F.col("blocks") / F.col("n")).cast("long").alias("parts")), "rest")


def _again(far: DataFrame, members: DataFrame, few: DataFrame) -> DataFrame:
    """Blocks that bring every `far` document of the nodes in `few` (see _rest) together with every member of its node."""
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    own = members.join(few, "node").select("node", "id", deal("id", "blocks").alias("block"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    more = far.join(few, "node").select("node", "id", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), deal("id", "parts").alias("part"))
    both = own.withColumn("pivot", F.lit(0)).unionByName(more.withColumn("pivot", F.lit(-1)))
    return both.select(F.xxhash64("node", "block", "part").alias("key"), "node", "id", "pivot")


def candidate_clusters(reps: DataFrame, width: int = SKETCH, looks: float = LOOKS) -> DataFrame:
    """reps (written): id, tokens, sketch of `width` values.  Returns id, node: the candidate clusters with two documents
    or more."""
    spark = reps.sparkSession
    sketches = reps.select("id", F.col("sketch").alias("body"), F.lit(False).alias("big"), F.col("id").alias("known"))

    def compared(rows: DataFrame, held: DataFrame) -> DataFrame:
        return _by_block(spark, rows.join(held, "id"), lambda t: _alike(t["body"].to_pylist(), t["known"].to_pylist(), width, looks))

    nodes = _roots(reps)
    every = nodes.where(F.col("tree") < FIRST).select("id", "node")
    here = written(every.join(every.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "node"), "nodes")
    large = here.where(F.col("n") > NODE).select("node", "id")
    rows = here.where(F.col("n") <= NODE).select(F.col("node").alias("key"), "node", "id", F.lit(0).alias("pivot")).unionByName(_blocks(large, written(_pivots(large, NODE), "pivots")))
    stars_ = written(compared(rows, sketches).where("not far"), "first")
    known = connected_components(stars_.select("a", "b")).withColumnRenamed("component_id", "known")
    sketches = written(sketches.drop("known").join(known.hint("merge"), "id", "left").withColumn("known", F.coalesce("known", "id")), "sketches")
    small, edges, held = [], [stars_], None
    for level in range(1, LEVELS + 1):
        every = nodes.select("id", "node", "tree") if level == 1 else written(nodes.select("id", "node", "tree"), "branches")
        counts = every.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        here = written(every.join(counts, "node"), "nodes")
        small.append(here.where((F.col("n") <= NODE) & (F.lit(level > 1) | (F.col("tree") >= FIRST))).select("node", "id"))
        large = here.where(F.col("n") > NODE).select("node", "id")
        sizes = written(_pivots(large, NODE), "pivots")
        if sizes.isEmpty():
            break
        if held is None:  # later levels meet no other documents
            held = written(sketches.join(large.select("id").distinct(), "id"), "held")
        found = written(compared(_blocks(large, sizes), held), "near")
        edges.append(found.where("not far"))
        far = found.where("far").select("node", F.col("a").alias("id")).distinct()
        # the rest of a node meets all of it where the rest is few (or the tree ends); other nodes branch on
        rest, ends = _rest(far, sizes), F.lit(level == LEVELS) | (F.col("m") <= NODE)
        edges.append(written(compared(_again(far, large, rest.where(ends)), held), "near"))
        open_ = rest.where(~ends).select("node")
        if open_.isEmpty():
            break
        nodes = _branches(nodes.join(sided(open_, is_few(open_)), "node", "left_semi"), level)
    rows = small[0]
    for s in small[1:]:
        rows = rows.unionByName(s)
    out = compared(rows.select(F.col("node").alias("key"), "node", "id", F.lit(0).alias("pivot")), sketches)
    for e in edges:
        out = out.unionByName(e)
    return connected_components(out.select("a", "b")).withColumnRenamed("component_id", "node")


def confirmed(clusters: DataFrame, texts: DataFrame, percent: int = 75, apart: bool = False) -> DataFrame:
    """clusters: node, id; texts: id, body.  Returns a, b: links on full sets, or stars of such, that connect what is
    connected.  apart: the clusters have been taken apart already."""
    spark = clusters.sparkSession

    def near(t):
        return stars(linked(shingle_sets(t["body"].combine_chunks()), percent))

    clusters = written(clusters, "clusters")
    # the texts of documents in clusters are all that is read from here on; merged, not broadcast, at every size, since
    # nothing bounds the number of clusters
    texts = written(texts.join(clusters.select("id").distinct().hint("merge"), "id"), "texts")
    weight = texts.select("id", F.octet_length("body").cast("long").alias("w"))
    sizes = written(_pivots(clusters.join(weight, "id"), GROUP, F.col("w")), "sizes")
    tiny = clusters.join(sizes.where(F.col("blocks") == 1).select("node"), "node").select(
        F.col("node").alias("key"), "node", "id", F.lit(0).alias("pivot"), F.lit(False).alias("big"))
    big_sizes = sizes.where(F.col("blocks") > 1)
    big = written(clusters.join(big_sizes.select("node"), "node"), "big")
    rows = tiny.unionByName(_blocks(big, big_sizes).withColumn("big", F.lit(True)))
    found = written(_by_block(spark, rows.join(texts, "id"), near).where(F.col("a") != F.col("b")), "links")
    out = found.where("not big").select("a", "b")  # compared in one go, so the star is the component
    if big.isEmpty():
        return written(out.distinct(), "confirmed")
    # a document is settled if it is in the largest component of its cluster; all others meet every member
    edges = found.where("big").select("a", "b")
    label = big.join(connected_components(edges), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    label = written(label, "label")
    most = label.groupBy("node", "component_id").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(
        F.max_by("component_id", F.struct("n", "component_id")).alias("top"))
    far = written(label.join(written(most, "most"), "node").where(F.col("component_id") != F.col("top")).select("node", "id"), "far")
    rest = _rest(far, big_sizes)
    wide = F.lit(not apart) & (F.col("parts") > PARTS)
    again = _again(far, big, rest.where(~wide)).withColumn("big", F.lit(True)).join(texts, "id")
    edges = edges.unionByName(_by_block(spark, again, near).where(F.col("a") != F.col("b")).select("a", "b"))
    unlike = big.join(rest.where(wide).select("node"), "node", "left_semi").select("id")
    if not unlike.isEmpty():
        again = texts.join(unlike, "id", "left_semi").select("id", "body").mapInArrow(lambda b: _describe(b, LONG_SKETCH), DESCRIBED)
        parts = candidate_clusters(written(again, "again"), LONG_SKETCH, LONG_LOOKS)
        edges = edges.unionByName(confirmed(parts, texts.select("id", "body"), percent, True))
    return written(out.unionByName(edges).distinct(), "confirmed")


@scratched
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (smallest id reachable by links, itself included),
    kept (id = component_id).  Documents link if 100 * intersection >= percent * union of their shingle sets; texts of
    fewer than five words are one shingle; null, empty and blank texts have none and link with nothing.  A null id is
    -2^63 in component_id; rows that share an id are one vertex of the graph.  No rows give no rows."""
    spark = docs.sparkSession
    python_side(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    two = docs.select(key.alias("id"), F.col(text_col).alias("body"))
    rows = written(two.mapInArrow(_describe, DESCRIBED), "sets")
    full, same = rows.where("n > 0"), ["n", "d1", "d2"]
    reps = written(full.groupBy(*same).agg(F.min("id").alias("rep")), "reps")
    # the first row of each set stands for it; hot sets are few and go by broadcast
    named = written(join_hot(rows.select("id", *same), reps, same, hot_keys(full, same)), "named")
    firsts = full.join(reps.select(F.col("rep").alias("id"), *same), ["id", *same]).dropDuplicates(["id", *same])
    firsts = written(firsts.select("id", "tokens", "sketch"), "firsts")
    clusters = candidate_clusters(firsts)
    links = confirmed(clusters, two, percent)
    parts = written(connected_components(written(links.unionByName(_bridges(named)), "graph")), "parts")
    out = named.withColumn("rep", F.coalesce("rep", "id"))
    hub = hot_keys(out, ["rep"])
    out = join_hot(out, parts.select(F.col("id").alias("rep"), "component_id"), ["rep"], hub)
    out = out.withColumn("component_id", F.coalesce("component_id", "rep"))
    back = F.when(F.col("id") != NO_ID, F.col("id"))
    return out.select(back.alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _bridges(named: DataFrame) -> DataFrame:
    """Edges between the representatives of an id that carries more than one set."""
    full = named.where(F.col("rep").isNotNull())
    many = full.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("id", "a")
    return full.join(many, "id").select("a", F.col("rep").alias("b"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5_number(array_to_string(w[i:i + 4], ' ')))
                                      WHEN len(w) > 0 THEN [md5_number(array_to_string(w, ' '))] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
e AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(id, c) AS (
  SELECT DISTINCT a, a FROM e
  UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.id WHERE r.c < e.b),
parts AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(parts.c, d.doc_id) AS component_id, coalesce(parts.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN parts ON parts.id = d.doc_id
"""
