import random
import zlib

import pytest

from storyloom.llm import quality as m


def corpus(n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("aeioutrsn") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        rows.append((k, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((k, int(good)))
    return rows, labels


def test_learns_and_holds_out_by_fold(spark):
    rows, labels = corpus()
    d = spark.createDataFrame(rows + [(9001, None), (9002, ""), (None, "a b c"), (5, "Again."), (9003, "w " * 200_000)], "doc_id long, text string")
    d = d.selectExpr("*", "'x' AS score", "0 AS label", "0 AS stats").repartition(4)
    noise = [(3, None), (None, 1), (7777, 1)]
    lab = spark.createDataFrame([(i, q) for i, q in labels] + noise, "doc_id long, quality int").selectExpr("*", "'y' AS text")
    # Labels of the held-out fold are turned over: they must not be learned from.
    from pyspark.sql import functions as F

    lab = lab.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    scored, model = m.classify(d, lab)
    got = scored.collect()
    assert len(got) == 605 and model.fitted and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id or "").encode()) % 4 == 2) for r in got if r.doc_id != 0)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert sum(truth[r.doc_id] == r.predicted for r in held) / len(held) > 0.95


def test_without_labels_and_without_documents(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored, model = m.classify(d, none)
    assert not model.fitted and [r.score for r in scored.collect()] == [0.5, 0.5]
    scored, _ = m.classify(d.limit(0), none)
    assert scored.count() == 0


def test_one_kind_of_label_only(spark):
    d = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    scored, _ = m.classify(d, spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int"))
    assert all(r.score == pytest.approx(1, abs=0.05) for r in scored.collect())


def test_isotonic_fit_is_monotone_and_keeps_the_mean():
    rng = random.Random(5)
    points = [(k / 50, float(rng.randint(1, 5)), 0.0) for k in range(50)]
    points = [(x, w, sum(rng.random() < x for _ in range(int(w)))) for x, w, _ in points]
    knots, values = m.pool_adjacent(points)
    assert values == sorted(values) and knots == sorted(knots)


def test_statistics_are_finite():
    import math

    for text in (None, "", "\n", " ", "é" * 10, "a" * 100_000, "\x00!?"):
        stats = m.statistics(text)
        assert len(stats) == m.N_STATISTICS and all(map(math.isfinite, stats))


def plain_scores(docs, labels, features=256, bins=4096, ridge=1e-3, seed=7):
    """Scores by dense matrices and an isotonic fit by its minimax formula."""
    import numpy as np

    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    stats = {i: np.array(m.statistics(t), np.float32).astype(float) for i, t in docs}
    used = [(i, q) for i, q in labels if q is not None and i in stats and fold(i) != 2]
    x, y = np.array([stats[i] for i, _ in used]), np.array([float(q) for _, q in used])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(x.shape[1], features)) / x.shape[1] ** 0.5, rng.uniform(0, 2 * np.pi, features)
    z = lambda s: np.append(np.cos(np.clip((s - mean) / scale, -8, 8) @ w + b) * (2 / features) ** 0.5, 1.0)
    fit = np.array([fold(i) != 3 for i, _ in used])
    a = np.array([z(s) for s in x])
    penalty = np.diag([ridge * fit.sum() / features] * features + [1e-9])
    beta = np.linalg.solve(a[fit].T @ a[fit] + penalty, a[fit].T @ y[fit])
    points = {}
    for raw, q in zip(a[~fit] @ beta, y[~fit], strict=True):
        k = int(np.clip((raw + 0.5) / 2 * bins, 0, bins - 1))
        n, s = points.get(k, (0, 0.0))
        points[k] = (n + 1, s + q)
    ks = sorted(points)
    mean_of = lambda i, j: sum(points[k][1] for k in ks[i : j + 1]) / sum(points[k][0] for k in ks[i : j + 1])
    level = [max(min(mean_of(i, j) for j in range(k, len(ks))) for i in range(k + 1)) for k in range(len(ks))]
    knots = []
    for v in sorted(set(round(v, 9) for v in level)):
        held = [k for k, u in zip(ks, level, strict=True) if round(u, 9) == v]
        n = sum(points[k][0] for k in held)
        knots.append((sum(points[k][0] * (-0.5 + (k + 0.5) * 2 / bins) for k in held) / n, v))
    at, values = zip(*knots, strict=True)
    return {i: float(np.clip(np.interp(z(s) @ beta, at, values), 0, 1)) for i, s in stats.items()}


def test_scores_match_a_plain_version(spark):
    rows, labels = corpus(240)
    rng = random.Random(6)
    rows += [(500, None), (501, "")]
    labels = [(i, 1 - q if rng.random() < 0.25 else q) for i, q in labels] + [(3, None), (999, 1)]  # so that there are levels to pool
    scored, _ = m.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"))
    want = plain_scores(rows, labels)
    assert len(set(want.values())) > 3
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got == pytest.approx(want, abs=1e-6)
