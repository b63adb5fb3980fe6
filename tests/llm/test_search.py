import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import search as m

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    """(item, rank, id, score) by scoring every document for every item."""
    held = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            big = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * big)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS score", "3 AS term").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS query", "2 AS item", "3 AS rank")
    return sorted((tuple(r) for r in m.search(d, b, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "Of", "日本", "été", "x1", "a_b"] + [f"w{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(rng.randint(-50, 10**10), " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for _ in range(n)], rng, words


@pytest.mark.parametrize("options", [{}, {"shard_docs": 7, "block_terms": 5, "k": 3}, {"shard_terms": 40, "k": 10}])
def test_matches_plain_version(spark, options):
    docs, rng, words = corpus(1, 250)
    docs += [(1, None), (2, ""), (3, " ;,. "), (None, "the w3 w4"), (None, "w3 the"), (docs[0]), (docs[0]), (9, "the w5 " * 20_000)]
    docs += [(k, "w7 w8 same words") for k in range(100, 160)]  # more ties than ranks
    items = [(f"q{k}", " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30])))) for k in range(12)]
    items += [("q0", items[0][1]), (None, "THE w9"), ("empty", None), ("none", "unheard of-it"), ("tie", "same"), ("all", "the " + " ".join(words))]
    assert run(spark, docs, items, **options) == plain(docs, items, options.get("k", 50))


def test_a_file_holds_one_shard(spark):
    docs = spark.createDataFrame([(k, "a b c") for k in range(9)], "doc_id long, text string").coalesce(1)
    built = m.build(docs, "doc_id", "text", 1, 10)
    sizes = [r["count"] for r in built.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 9 and max(sizes) == 1


def test_empty_tables(spark):
    assert run(spark, [], [("a", "b")]) == []
    assert run(spark, [(1, "b")], []) == []
    # With one document a term's weight is floor(1000 * ln(4 / 3)).
    assert run(spark, [(1, "b")], [("a", "B b")]) == [("a", 1, 1, 287 * (10**9 // (1000 + 20 * 100)))]


def shard(docs, block, k=10**9):
    """The only shard of docs, with its numbers of documents and terms."""
    rows = pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])})
    (built,) = m.builder(k, k)([rows])
    n_terms = sum(len(terms(t)) for _, t in docs)
    row = {c: built.column(c)[0].values for c in ("ids", "lengths", "terms", "dfs")} | {c: built.column(c)[0].as_py() for c in ("docs", "tfs")}
    return m.Impacts(row, block, len(docs), n_terms)


def test_stops_before_the_end_and_is_exact():
    rng = random.Random(3)
    docs = [(k, " ".join(["the", "of"] * rng.randint(1, 9) + [f"r{rng.randint(0, 300)}"] * rng.randint(0, 2) + ["x"] * rng.randint(0, 40))) for k in range(20_000)]
    held = Counter(t for _, text in docs for t in set(terms(text)))
    w = lambda t: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * held[t] + 1)))
    block = m.Block([(q, t, w(t)) for q in range(20) for t in {"the", "of", "x", f"r{q}", f"r{q + 50}"}])
    s = shard(docs, block)
    total = [int(s.size[m.spans(s.first[t], s.last[t] - s.first[t])].sum()) for t in block.queries.values()]
    processed = []
    for (query, own), n in zip(block.queries.items(), total, strict=True):
        found, scores, done = s.best(own, 10, 1, step=64)
        whole = s.complete(np.arange(s.n), own)
        assert (whole[found] == scores).all()
        kth = np.sort(whole)[-10]
        assert set(np.flatnonzero(whole >= max(kth, 1))) <= set(found.tolist()), query
        processed.append(done / n)
        # A floor from other shards leaves out only what is below it.
        floor = int(kth) + 1
        above, scores, _ = s.best(own, 10, floor, step=64)
        assert set(np.flatnonzero(whole >= floor)) <= set(above.tolist()) and (whole[above] == scores).all()
    assert np.median(processed) < 0.5


def test_groups_are_exact_impacts_in_falling_order():
    docs, _, words = corpus(4, 400)
    block = m.Block([(0, t.lower(), 10 + k) for k, t in enumerate(words)])
    s = shard(docs, block)
    for t in range(len(block.terms)):
        own = s.impact[s.first[t] : s.last[t]]
        assert (np.diff(own) < 0).all()
    assert s.size.sum() == len(s.docs) == len(s.by_doc_impact)
