"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps: each step is one minimum per vertex (combined
before the shuffle) and one equality join, so a vertex with very many neighbours is summed
map-side and its join partition can be split at run time. Each round is written to the shared
folder, which cuts the lineage; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.shared import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of each vertex with an edge; component is the smallest id reachable.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    e = materialize(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "edges",
    )
    before = signature(e)
    while before[0]:
        old, e = e, materialize(small_star(large_star(e)), "edges")
        discard(old)
        now = signature(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def signature(e: DataFrame) -> tuple:
    """Tells whether a round has changed the edges; sums of hashes don't depend on the order."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return row.n, row.h


def large_star(e: DataFrame) -> DataFrame:
    """Links the larger neighbours of each vertex to the smallest of it and its neighbours."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Links each vertex and its smaller neighbours to the smallest of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
