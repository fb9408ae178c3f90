"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratched, written


#: Edges for each task of a step, at least.
EDGES = 250_000


@scratched
def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  Returns id, component_id (the smallest id reachable) for every id on an edge that is no
    loop.  The two sides of each join are tables of their own, so Spark can split the rows of an id with very many
    edges; sums run map-side first.  A step has as many tasks as its edges call for, since there are many steps."""
    e = written(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen, tasks = mark, max(8, -(-mark[0] // EDGES))

        def nearest(pairs: DataFrame, tasks=tasks) -> DataFrame:
            return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "near", tasks)

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        far = both.where(F.col("v") > F.col("u")).join(nearest(both), "u")
        e = written(far.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large", tasks)
        near = nearest(e)
        rest = e.join(near, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(rest.unionByName(near.select("u", F.col("m").alias("v"))).distinct(), "small", tasks)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()


def stars(links) -> list[tuple[int, int]]:
    """(member, smallest member of its component) of a symmetric boolean matrix, singles left out: by position."""
    import numpy as np

    n = len(links)
    label = np.arange(n)
    while True:
        low = np.where(links, label[None, :], n).min(axis=1) if n else label
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(i), int(c)) for i, c in enumerate(label) if i != c]
