"""Greedy claims in parallel: who keeps what it claims, if all come one after the other.

Owners claim keys in an order (all by a first one, then the next). An owner is kept if none of its keys is
claimed yet, and then its keys are; an owner that isn't kept claims nothing. This is the greedy independent
set of the graph in which owners of one key are neighbours, and no decision depends on more than the
neighbours that come earlier. So

1. in a round, every owner that is the first of the undecided ones on all its keys is kept, and the others on
   these keys go. A round is one minimum per key, summed up before the shuffle, and equality joins; a key that
   very many claim is one row of the minimum and no pairs. Owners in random order are decided in few rounds;
2. after ``rounds`` of these, what is undecided is divided into components, as owners without a common key,
   directly or through others, don't bear on each other. A component of at most ``fold_owners`` is walked by a
   task in the order itself;
3. of a larger component that many owners are walked, the first ones; these are decided as what comes later
   doesn't bear on them. The rounds go on with the rest. So a chain, in which every decision waits for the one
   before, ends as well, by fold_owners a step.

A task holds fold_owners owners at most, and every step's tables are written, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.components import connected_components
from storyloom.shared import discard, materialize


def greedy_losers(claims: DataFrame, order: list[Column], *, rounds: int = 4, fold_owners: int = 100_000) -> DataFrame:
    """(owner) of all owners that aren't kept. claims: rows (owner, key, and columns that order names); owners of
    equal order are told apart by themselves. Rows with a null owner or key are ignored, repeated ones are one."""
    rank = F.struct(*order, "owner").alias("rank")
    spark = claims.sparkSession
    rows = claims.where(F.col("owner").isNotNull() & F.col("key").isNotNull()).select("owner", "key", rank)
    # A key with one owner decides nothing.
    shared = rows.groupBy("key").agg(F.min("owner").alias("x"), F.max("owner").alias("y")).where("x <> y").select("key")
    live = materialize(rows.join(shared, "key").distinct(), "claims")
    lost = spark.createDataFrame([], rows.select("owner").schema)
    while not live.isEmpty():
        for _ in range(rounds):
            live, gone = _without(live, _round(live))
            lost = lost.unionAll(gone)
            if live.isEmpty():
                return lost
        live, gone = _without(live, _walk(live, fold_owners))
        lost = lost.unionAll(gone)
    return lost


def _round(live: DataFrame) -> DataFrame:
    """Owners that are first on all their keys."""
    first = live.groupBy("key").agg(F.min("rank").alias("first"))
    return live.join(first, "key").groupBy("owner").agg(F.min(F.col("rank") == F.col("first")).alias("all_")).where("all_").select("owner")


def _without(live: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The undecided claims after these owners are kept, and who goes."""
    kept = materialize(kept, "kept")
    taken = live.join(kept, "owner", "left_semi").select("key").distinct()
    gone = live.join(taken, "key", "left_semi").select("owner").distinct().join(kept, "owner", "left_anti")
    gone = materialize(gone, "gone")
    rest = live.join(kept, "owner", "left_anti").join(gone, "owner", "left_anti")
    after = materialize(rest, "claims")
    discard(live)
    discard(kept)
    return after, gone


def _walk(live: DataFrame, fold_owners: int) -> DataFrame:
    """The kept ones among the first fold_owners owners of every component."""
    first = live.groupBy("key").agg(F.min("owner").alias("x"))
    met = live.join(first, "key")
    found = connected_components(met.select(F.col("x").alias("a"), F.col("owner").alias("b")), "a", "b").withColumnsRenamed({"id": "owner"})
    # Owners whose keys are theirs alone by now have no neighbour: each is a component.
    owners = live.select("owner", "rank").distinct().join(found, "owner", "left").withColumn("component", F.coalesce("component", "owner"))
    place = Window.partitionBy("component").orderBy("rank")
    head = owners.withColumn("place", F.row_number().over(place)).where(F.col("place") <= fold_owners).select("owner", "component", "place")
    rows = live.select("owner", "key").join(head, "owner").select("component", "place", "owner", "key")

    def walk(group):
        import numpy as np
        import pyarrow as pa

        group = group.combine_chunks()
        if not group.num_rows:
            return group.select(["owner"])
        at = np.argsort(group.column("place").to_numpy(), kind="stable")
        place = group.column("place").to_numpy()[at]
        key = group.column("key").combine_chunks().dictionary_encode().indices.to_numpy()[at]
        starts = np.flatnonzero(np.r_[True, np.diff(place) != 0])
        taken, kept = set(), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
            own = key[a:b].tolist()
            if taken.isdisjoint(own):
                taken.update(own)
                kept.append(at[a])
        return group.select(["owner"]).take(pa.array(kept, pa.int64()))

    return rows.groupBy("component").applyInArrow(walk, f"owner {dict(live.dtypes)['owner']}")
