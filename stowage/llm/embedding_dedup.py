"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Every vector goes home to the cell of its nearest centroid and is met by the vectors of each cell that could hold one
close enough to link with it: if x lives in cell c and y in cell h, then y . (c_h - c_c) <= |x - y| |c_h - c_c|, and linked
unit vectors are at most sqrt(2 - 2 * limit) apart.  So the search is exact, whatever the centroids.

There are two levels, both by the number of rows alone.  A label with more than BLOCK rows is dealt to regions: centroids
fitted on a bounded sample, a vector is copied to each region within reach, and a region is met in blocks of BLOCK home
rows by BLOCK rows, however large it is.  Within a block (and all of a smaller label is one) a task fits cells of about
CELL_ROWS rows, at least LEAST_CELLS, and works through each cell's products in tiles; a tile gives the number of links of
each home row and a star for each component, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, is_few, n_parts, python_side, scratched, sided, written
from .graph import connected_components, stars
from .near_dedup import groups

LIMIT, BLOCK, TILE = 0.93, 8192, 1024
#: Rows that centroids are fitted on, and the most regions.
SAMPLE, MOST_REGIONS = 8192, 1024
#: Cells of a block: rows aimed at, the least and the most.
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 64, 8, 128


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def gaps(c: np.ndarray) -> np.ndarray:
    """The distance of each two centroids."""
    n = (c * c).sum(axis=1)
    return np.sqrt(np.maximum(0, n[:, None] + n[None, :] - 2 * (c @ c.T)))


def nearby(x: np.ndarray, c: np.ndarray, reach: float, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and whether each cell may hold a vector within reach of it.  gap: gaps(c)."""
    dots = x @ c.T
    gap = gaps(c) if gap is None else gap
    home = dots.argmax(axis=1)
    return home, dots[np.arange(len(x)), home][:, None] - dots <= reach * gap[home] + 1e-6


def n_regions(rows: int) -> int:
    return max(1, min(MOST_REGIONS, -(-rows // BLOCK)))


def n_cells(rows: int) -> int:
    return max(LEAST_CELLS, min(MOST_CELLS, rows // CELL_ROWS))


def cells_of(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a block's unit vectors: home of each, and which cells it must be compared in."""
    sample = x if len(x) <= SAMPLE // 4 else x[np.random.default_rng(len(x)).choice(len(x), SAMPLE // 4, replace=False)]
    return nearby(x, spherical_kmeans(sample, n_cells(len(x))), reach)


def packed(a: np.ndarray) -> bytes:
    """Doubles as bytes, in half the room where that is exact."""
    with np.errstate(over="ignore"):
        half = a.astype("<f4")
    return (half if (half.astype(np.float64) == a).all() else a).tobytes()


def unit(vectors: list[bytes], dim: int | None = None) -> np.ndarray:
    """Unit vectors of packed ones; dim: their length, where they may be packed by half."""
    if dim is None:
        x = np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)
    else:
        x = np.empty((len(vectors), dim))
        for i, v in enumerate(vectors):
            x[i] = np.frombuffer(v, dtype="<f4" if len(v) == 4 * dim else np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches):
    """id, mark, label, dim, vec (packed) of the vectors that can link."""
    for batch in batches:
        ids, marks, labels, vecs = (c.to_pylist() for c in batch.columns)
        keep = []
        for i, v in enumerate(vecs):
            if v and labels[i] is not None and None not in v:
                a = np.array(v, dtype=np.float64)
                if np.isfinite(a).all() and a.any():
                    keep.append((ids[i], marks[i], labels[i], len(v), packed(a)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in keep], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()))],
            names=["id", "mark", "label", "dim", "vec"])


def _regions(batches, regions: dict[int, tuple[np.ndarray, np.ndarray]], reach: float):
    """A row for each vector and region that it goes to: id, mark, label, dim, cell, home, vec."""
    for batch in batches:
        ids, marks, labels, dims, vecs = (c.to_pylist() for c in batch.columns)
        out: list[tuple] = []
        for dim in sorted(set(dims)):
            some = [i for i, d in enumerate(dims) if d == dim]
            c, gap = regions.get(dim, (np.zeros((1, dim)), None))
            home, near = nearby(unit([vecs[i] for i in some], dim), c, reach, gap)
            for r, cell in zip(*np.nonzero(near), strict=True):
                i = some[r]
                out.append((ids[i], marks[i], labels[i], dim, int(cell), bool(home[r] == cell), vecs[i]))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)],
                                         names=["id", "mark", "label", "dim", "cell", "home", "vec"])


def _tile(x: np.ndarray, ids: np.ndarray, mine: np.ndarray, other: np.ndarray, limit: float, rows: set) -> np.ndarray:
    """Links of each of `mine` with `other`; their stars go to rows."""
    link = (x[mine] @ x[other].T >= limit) & (ids[mine][:, None] != ids[other][None, :])
    n = link.sum(axis=1)
    some, cols = np.flatnonzero(n), np.flatnonzero(link.any(axis=0))
    if len(some):
        both = np.zeros((len(some) + len(cols),) * 2, dtype=bool)
        both[: len(some), len(some):] = link[some][:, cols]
        who = np.concatenate((ids[mine[some]], ids[other[cols]]))
        rows.update((int(who[j]), int(who[i]), None, None, None) for i, j in stars(both | both.T) if who[i] != who[j])
    return n


def _products(batches, limit: float, reach: float):
    """a, b, mark, n, key: stars (n null), and the links of a home row in one block (b null)."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    for t in groups(batches, "key"):
        ids, marks, side = (t[c].to_numpy() for c in ("id", "mark", "side"))
        if side.all() or not side.any():
            continue
        key = t["key"][0].as_py()
        x = unit(t["vec"].to_pylist(), t["dim"][0].as_py())
        home, near = cells_of(x, reach)
        rows: set[tuple] = set()
        for cell in range(near.shape[1]):
            own, every = np.flatnonzero(side & (home == cell)), np.flatnonzero(~side & near[:, cell])
            for lo in range(0, len(own), TILE):
                mine = own[lo:lo + TILE]
                total = sum((_tile(x, ids, mine, every[at:at + TILE], limit, rows) for at in range(0, len(every), TILE)), np.zeros(len(mine), dtype=np.int64))
                rows.update((int(ids[i]), None, int(marks[i]), int(n), key) for i, n in zip(mine, total, strict=True) if n)
        out = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], ty) for j, ty in enumerate(types)], names=["a", "b", "mark", "n", "key"])


def _fitted(big: DataFrame, reach: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centroids of regions by length of vector, from the rows of large labels: a number by the largest label's rows, on a
    sample drawn by a hash of id and vector.  A length is on the list only if it has more than BLOCK rows."""
    out = {}
    most = big.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n"))
    for r in most.collect():
        draw = F.xxhash64(F.lit("kmeans"), "id", "vec")
        sample = big.where(F.col("dim") == r["dim"]).select(draw.alias("h"), "vec").orderBy("h", "vec").limit(SAMPLE).collect()
        c = spherical_kmeans(unit([s["vec"] for s in sample], r["dim"]), n_regions(r["n"]))
        out[r["dim"]] = (c, gaps(c))
    return out


@scratched
def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    limit: float = LIMIT) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id (smallest id reachable by links), kept (id =
    component_id).  Only rows of one label and one length link, at cosine >= limit in double precision.  A null or
    empty or zero vector, one with null or non-finite components, and one with a null label link with nothing.  A null
    id is -2^63 in component_id.  Rows that share an id are one vertex and no link to each other; n_links of a row counts
    the rows of other ids that it links with itself, copies each.  No rows give no rows."""
    spark = vectors.sparkSession
    python_side(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = vectors.select(key.alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.select("id", F.xxhash64("label", "vec").alias("mark"), "label", "vec")
    good = written(rows.mapInArrow(_packed, "id long, mark long, label string, dim int, vec binary"), "vectors")
    reach = float(np.sqrt(2 - 2 * limit))
    large = written(good.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("label", "dim"), "large")
    cols = ["id", "mark", "label", "dim", "cell", "home", "vec"]
    placed = good.withColumns({"cell": F.lit(0), "home": F.lit(True)}).select(*cols)
    if not large.isEmpty():
        side = sided(large, is_few(large))
        big = written(good.join(side, ["label", "dim"], "left_semi").select(*good.columns), "big")
        regions = spark.sparkContext.broadcast(_fitted(big, reach))  # MOST_REGIONS a length at most
        dealt = big.mapInArrow(lambda b: _regions(b, regions.value, reach), "id long, mark long, label string, dim int, cell int, home boolean, vec binary")
        placed = written(placed.join(side, ["label", "dim"], "left_anti").select(*cols).unionByName(dealt), "regions")
    node = ["label", "dim", "cell"]
    sizes = written(placed.groupBy(*node).agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).alias("own"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("all")).where("own > 0"), "sizes")
    both = placed.join(sizes, node)
    h = F.xxhash64("id")
    span = lambda n: F.explode(F.expr(f"sequence(0L, `{n}` - 1)"))
    left = both.where("home").select(*node, F.pmod(h, F.col("own")).alias("i"), span("all").alias("j"), F.lit(True).alias("side"), "id", "mark", "vec")
    right = both.select(*node, span("own").alias("i"), F.pmod(h, F.col("all")).alias("j"), F.lit(False).alias("side"), "id", "mark", "vec")
    dealt = left.unionByName(right).select(F.xxhash64(*node, "i", "j").alias("key"), "side", "id", "mark", "dim", "vec")
    dealt = dealt.repartition(n_parts(spark), "key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(lambda b: _products(b, limit, reach), "a long, b long, mark long, n long, key long"), "links")
    links = written(found.where("n is not null").groupBy(F.col("a").alias("id"), "mark", "key").agg(F.max("n").alias("n")).groupBy("id", "mark").agg(
        F.sum("n").alias("n_links")), "counts")
    parts = written(connected_components(found.where("n is null").select("a", "b")), "parts")
    out = rows.select("id", "mark").join(links, ["id", "mark"], "left").join(parts, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(id, c) AS (
  SELECT DISTINCT a, a FROM links
  UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE r.c < l.b),
parts AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
n AS (SELECT a, count(*)::BIGINT AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(parts.c, v.vec_id) AS component_id,
       coalesce(parts.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN parts ON parts.id = v.vec_id
"""
