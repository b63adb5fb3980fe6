import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import language_model as m
from storyloom.llm import recurrent as r

SMALL = dict(common_words=60, heads=2, width=8, rest=5, hidden=6, rounds=2)


def tokens(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + [None]


def corpus(n=300):
    rng = random.Random(11)
    words = {k: [f"{p}{''.join(rng.choice('abcdefgh') for _ in range(rng.randint(1, 3)))}" for _ in range(60)] for k, p in (("x", "X"), ("y", "y"))}
    return [(k, " ".join(rng.choice(words["x" if k % 2 else "y"]) for _ in range(rng.randint(0, 60)))) for k in range(n)]


def test_base_scores_counts_and_gain(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, "İ never\x0bseen \xa0 words"), (None, "xa yb"), (5, "twice"), (5, "twice"), (1003, "xa " * 30_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'w' AS word", "2 AS rare").repartition(3)
    got = m.log_likelihoods(d, **SMALL).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = sorted(
        ("" if i is None else str(i), held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 4))
        for i, t in rows
    )
    assert sorted(("" if x.doc_id is None else str(x.doc_id), x.held_out, x.n_tokens, x.n_known, round(x.base_score, 4)) for x in got) == want
    assert all(x.train_tokens == n and x.score < 0 for x in got)


def test_context_helps_on_held_out_texts(spark):
    d = spark.createDataFrame(corpus(4000), "doc_id long, text string").repartition(2)
    out = [x for x in m.log_likelihoods(d, **(SMALL | {"rate": 0.03})).collect() if x.held_out]
    assert sum(x.score for x in out) > 0.985 * sum(x.base_score for x in out)


def plain_score(text, vocab, w, counts):
    """log10 probability of a text, word by word, from the weights and the corpus's counts."""
    shape, n_head = vocab.shape, vocab.shape.heads * vocab.shape.width
    ranked = sorted(vocab.index, key=vocab.index.get)
    head = {word: k + 1 for k, word in enumerate(ranked[: n_head - 1])}
    rest = lambda word: vocab.endings.get(word[-2:], shape.rest - 1)
    class_n, class_v = Counter(), Counter()
    for word, n in counts.items():
        if word is not None and word.encode() not in head:
            class_n[rest(word.encode())] += n
            class_v[rest(word.encode())] += 1
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, total = np.zeros(shape.hidden), 0.0
    for t in tokens(text):
        raw = None if t is None else t.encode()
        code = 0 if t is None else head.get(raw, None)
        by_class = softmax(h @ w["Wc"] + w["bc"])
        if code is None:
            k = rest(raw)
            code = n_head + k
            share = (counts[t] + 0.1) / (class_n[k] + 0.1 * (class_v[k] + 1))
            total += math.log10(by_class[shape.heads + k]) + math.log10(share)
        else:
            k, j = divmod(code, shape.width)
            total += math.log10(by_class[k]) + math.log10(softmax(h @ w["Ww"][k] + w["bw"][k])[j])
        z, r_ = (sigmoid(w["E"][g][code] + h @ w["U"][g]) for g in (0, 1))
        c = np.tanh(w["E"][2][code] + r_ * (h @ w["U"][2]))
        h = (1 - z) * h + z * c
    return total


def test_scores_match_a_plain_version(spark, monkeypatch):
    rows = [*corpus(150), (900, None), (901, "xa never seen xb"), (902, "été " * 40)]
    kept, held = m.train, []

    def train(training, vocab, rounds, rate):
        held.append((vocab, weights := kept(training, vocab, rounds, rate)))
        return weights

    monkeypatch.setattr(m, "train", train)
    got = {x.doc_id: x for x in m.log_likelihoods(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **SMALL).collect()}
    counts = Counter(t for i, text in rows if not got[i].held_out for t in tokens(text))
    vocab, w = held[0]
    assert len(vocab.index) <= 60 < len(counts)
    for i, text in rows:
        assert got[i].score == pytest.approx(plain_score(text, vocab, w, counts), rel=1e-4, abs=1e-3)


def test_without_training_rows(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    d = spark.createDataFrame([(ids[0], "a b"), (ids[1], None)], "doc_id long, text string")
    got = m.log_likelihoods(d, **SMALL).collect()
    assert all(x.n_known == 0 and x.train_tokens == 0 and x.base_score == 0 and math.isfinite(x.score) for x in got)
    assert m.log_likelihoods(d.limit(0), **SMALL).count() == 0


def test_probabilities_of_all_codes_add_up_to_one():
    shape = r.Shape(3, 4, 5, 6)
    w = r.initial(shape, np.arange(1, shape.codes + 1))
    prefix = [2, 7, 13]
    total = sum(math.exp(r.log_likelihoods(w, shape, [np.array([*prefix, k], np.int16)])[0]) for k in range(shape.codes))
    assert total == pytest.approx(math.exp(r.log_likelihoods(w, shape, [np.array(prefix, np.int16)])[0]), rel=1e-4)


def test_likelihood_is_that_of_the_document_alone():
    shape, rng = r.Shape(3, 4, 5, 6), np.random.default_rng(0)
    w = r.initial(shape, np.ones(shape.codes))
    docs = [rng.integers(0, shape.codes, int(n)).astype(np.int16) for n in rng.integers(1, 90, 60)]
    alone = [r.log_likelihoods(w, shape, [d])[0] for d in docs]
    assert np.allclose(r.log_likelihoods(w, shape, docs, most=7, steps=5), alone, atol=1e-3)


def test_gradients_match_differences():
    shape, rng = r.Shape(2, 3, 4, 5), np.random.default_rng(1)
    w = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in r.initial(shape, np.ones(shape.codes)).items()}
    tokens = rng.integers(0, shape.codes, (6, 4))
    start = rng.random((6, 4)) < 0.2
    valid = np.ones((6, 4), bool)
    valid[4:, 3] = False
    h = np.zeros((4, 5))
    grad, _, _ = r.gradients(w, shape, tokens, start, valid, h)

    def loss():
        s, _, _, _ = r.states(w, tokens, start, h)
        got, _ = r.outputs(w, shape, s.reshape(-1, 5).astype(float), tokens.ravel())
        return -(got @ valid.ravel()) / valid.sum()

    for k in w:
        for _ in range(5):
            i = tuple(rng.integers(0, n) for n in w[k].shape)
            held = w[k][i]
            w[k][i] = held + 1e-2
            up = loss()
            w[k][i] = held - 1e-2
            down = loss()
            w[k][i] = held
            assert grad[k][i] == pytest.approx((up - down) / 2e-2, abs=2e-4)
