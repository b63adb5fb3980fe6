import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom.operators import archive
from storyloom.operators.claims import greedy_losers

CLAIM = "owner string, key string, at long"


def plain(rows):
    """Who goes, one after the other."""
    keys, at = {}, {}
    for owner, key, t in rows:
        if owner is not None and key is not None:
            keys.setdefault(owner, set()).add(key)
            at[owner] = t
    taken, gone = set(), []
    for owner in sorted(keys, key=lambda o: (at[o] is not None, at[o] or 0, o)):
        if keys[owner] & taken:
            gone.append(owner)
        else:
            taken |= keys[owner]
    return sorted(gone)


def run(spark, rows, **options):
    d = spark.createDataFrame(rows, CLAIM).repartition(3)
    return sorted(r.owner for r in greedy_losers(d, [F.col("at")], **options).collect())


@pytest.mark.parametrize("options", [{}, {"rounds": 1, "fold_owners": 3}])
def test_matches_the_walk(spark, options):
    rng = random.Random(2)
    rows = [(f"o{k}", f"k{rng.randint(0, 60)}", k * 7 % 50 if k % 9 else None) for k in range(120) for _ in range(rng.randint(1, 4))]
    rows += [(f"chain{k:03}", f"c{k + j}", 1000 + k) for k in range(40) for j in (0, 1)]
    rows += [(None, "k1", 1), ("o1", None, 7), *rows[:9], ("alone", "only", 3), ("alone", "k-none", 3)]
    assert run(spark, rows, **options) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [("a", "x", 1), ("b", "y", 1)]) == []


def component(n, seed):
    """Owners in one component: a chain of keys, a key that a third of all claim, and random ones."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        t = rng.randint(0, 10**6)
        rows += [(f"o{k:06}", f"next{k + j}", t) for j in (0, 1)]
        rows += [(f"o{k:06}", f"any{rng.randint(0, n)}", t)]
        if k % 3 == 0:
            rows.append((f"o{k:06}", "hot", t))
    return rows


def test_a_component_of_twenty_thousand(spark):
    rows = component(20_000, 3)
    # Without a walk of more than fifty owners in one task.
    assert run(spark, rows, fold_owners=50) == plain(rows)


def test_a_chain_in_which_each_waits_for_the_one_before(spark):
    rows = [(f"o{k:05}", f"u{k + j}", k) for k in range(20_000) for j in (0, 1)]
    assert run(spark, rows, rounds=2) == [f"o{k:05}" for k in range(1, 20_000, 2)]
    assert run(spark, rows[:2000], rounds=1, fold_owners=300) == [f"o{k:05}" for k in range(1, 1000, 2)]


def test_merge_of_items_in_one_component(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    item = "cluster_id string, sources array<struct<name:string,url:string>>, published_at timestamp, updated_at timestamp"
    rows = []
    for k in range(3000):
        urls = [f"u{k}", f"u{k + 1}", rng.choice(["", f"x{rng.randint(0, 500)}"])]
        rows.append((f"c{k:05}", [("n", u) for u in urls], start, start + timedelta(seconds=rng.randint(0, 5000))))
    rows.append(("none", None, start, start))
    got = archive.merge(spark.createDataFrame(rows[:100], item), spark.createDataFrame(rows, item), fold_owners=20).collect()
    claims = [(i, u, -int(t.timestamp())) for i, sources, _, t in rows for _, u in sources or [] if u]
    gone = set(plain(claims))
    assert sorted(r.cluster_id for r in got) == sorted(r[0] for r in rows if r[0] not in gone)
