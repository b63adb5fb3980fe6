import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import nearest as m

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[ids == q][0]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def run(spark, rows, **options):
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS list", "2 AS v", "3 AS score").repartition(3)
    got = {}
    for r in sorted(m.nearest(d, F.col("vec_id") % 5 == 0, **options).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    return got


def test_recall_on_scattered_and_clustered_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(1500, 16)))]
    centres = rng.normal(size=(20, 16)) * 4
    rows += [(1500 + k, (centres[k % 20] + rng.normal(size=16) * 0.3).tolist()) for k in range(1500)]
    rows += [(3000 + k, (centres[0] * 3 + rng.normal(size=16) * 0.01).tolist()) for k in range(500)]  # a crowd
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    got = run(spark, rows, list_rows=64, block_rows=100)
    want = plain(rows, [i for i, _ in rows if i % 5 == 0])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall > 0.9
    score = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(s == pytest.approx(score[q, i], abs=1e-12) for q, found in got.items() for i, s in found if (q, i) in score)


def test_copies_ties_and_rows_that_take_no_part(spark):
    rows = [(k, [1.0, 0.0]) for k in range(40)] + [(100 + k, [0.0, float(2**k)]) for k in range(8)] + [(200, [1.0, 1.0])]
    odd = [(300, None), (305, []), (310, [0.0, 0.0]), (315, [1.0, None]), (320, [float("nan"), 1.0]), (325, [float("inf"), 1.0]), (330, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0])]
    got = run(spark, rows + odd)
    want = plain(rows, [i for i, _ in rows if i % 5 == 0])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[35]] == [0, 1, 2, 3, 4]


def test_few_candidates_and_none(spark):
    assert run(spark, [(5, [1.0, 0.0]), (6, [1.0, 1.0])]) == {5: [(6, pytest.approx(0.5**0.5))]}
    assert run(spark, [(5, [1.0, 0.0])]) == {} and run(spark, []) == {}


def test_graph_search_finds_the_nearest_centroids_and_looks_at_few():
    rng = np.random.default_rng(2)
    index = m.Index(rng.normal(size=(12000, 6)), 800)
    x = m.unit(rng.normal(size=(300, 6)))
    index.compared = 0
    at, d = index.search(x, 20)
    assert index.compared < 0.35 * len(x) * len(index.centres)
    exact = np.argsort(-(x @ index.centres.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(at, exact, strict=True)]) > 0.9
    assert (np.diff(d, axis=1) >= 0).all()


def measured(x, n_lists, target=0.96):
    """(recall, share of rows scored, lists) of an index calibrated on x, over queries of its own."""
    x = m.unit(x)
    index = m.Index(x, n_lists)
    true = lambda q: np.argsort(-(x[q] @ x.T), axis=1, kind="stable")[:, 1:6]
    own = np.arange(0, len(x), 16)
    index.calibrate(x[own], np.repeat(np.arange(len(own)), 5), x[true(own).ravel()], target, 2, 1.15)
    asked = np.arange(3, len(x), 20)
    rows, lists = index.postings(x, 2, 1.15)
    member = np.zeros((len(x), len(index.centres)), bool)
    member[rows, lists] = True
    probed = np.zeros((len(asked), len(index.centres)), bool)
    probed[index.probes(x[asked])] = True
    recall = np.mean([(member[t] & p).any(axis=1).mean() for t, p in zip(true(asked), probed, strict=True)])
    return recall, (probed @ member.sum(axis=0)).mean() / len(x), member.sum(axis=0), index


def test_few_rows_are_scored_where_vectors_are_clustered():
    rng = np.random.default_rng(5)
    recall, share, _, index = measured((rng.normal(size=(60, 32)) * 3)[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32)), 96)
    assert recall > 0.93 and share < 0.2 and index.width < 48
    recall, share, _, index = measured(rng.normal(size=(6000, 32)), 96)  # scattered: less than a full scan
    assert recall > 0.93 and share < 1 and index.width < 96


def test_lists_are_balanced():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 8)), rng.normal(size=(3000, 8)) * 0.01 + 5])
    index = m.Index(x, 32)
    rows, lists = index.postings(m.unit(x), 1, 1.0)
    assert np.bincount(lists, minlength=32).max() < 3 * len(x) / 32


def test_shards_hold_whole_lists_or_parts_of_one():
    plan = m.Shards.plan(np.array([3, 4, 2, 25, 0, 1, 9]), 10)
    assert plan.of.tolist() == [0, 0, 0, 1, 2, 2, 2] and plan.parts.tolist() == [1, 3, 1]
