import random

import corpus_pipeline
from storyloom.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(texts):
    """The smallest id of each component of pairs at a Jaccard similarity of 0.8 or more."""
    sets = {k: plain_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k for k in texts if find(k) == k}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    texts = [" ".join(word() for _ in range(rng.randint(60, 260))) for _ in range(40)]
    for k in range(20):  # copies with 1 to 10 other words, above and below the bound
        for changes in range(1, 11):
            w = texts[k].split()
            for at in rng.sample(range(len(w)), changes):
                w[at] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(110)]
    for _ in range(90):  # a large group whose members are near the bound
        w = list(base)
        w[rng.randrange(len(w))] = word()
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    drift = [word() for _ in range(120)]
    for _ in range(40):  # a chain whose ends are strangers
        drift[rng.randrange(len(drift))] = word()
        texts.append(" ".join(drift))
    texts += [None, "", "one two", "One  two", "one two three", texts[0].upper()]
    return dict(enumerate(texts))


def test_stage_keeps_one_of_each_group_of_similar_texts(spark):
    texts = corpus()
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_kept(texts)


def test_bound_is_met_exactly(spark):
    words = [f"w{k}" for k in range(44)]  # 40 shingles
    near = words[:-4] + ["x"] * 4  # 4 others: 36 of 44 are common
    far = words[:-5] + ["x"] * 5  # 5 others: 35 of 45 are common
    rows = [(k, " ".join(w)) for k, w in enumerate([words, near, far])]
    found = near_copies.near_copies(spark.createDataFrame(rows[:2], "doc_id long, text string"))
    assert found.select("component_fp").distinct().count() == 1
    found = near_copies.near_copies(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string"))
    assert found.select("component_fp").distinct().count() == 2


def test_small_blocks_lose_no_link(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {}
    for r in near_copies.near_copies(docs, block_hashes=1500).collect():
        kept[r.component_fp] = min(r.doc_id, kept.get(r.component_fp, r.doc_id))
    assert set(kept.values()) == plain_kept(texts)


def test_counts_of_common_elements_are_those_of_the_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [rng.choice(400, rng.integers(0, 120), replace=False) for _ in range(90)]
    owner = np.repeat(np.arange(90), [len(s) for s in sets])
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = 0
    for first, counts in near_copies.common_counts(owner, inverse, df, 90, dense_df=20, strip=32):
        for k, row in enumerate(counts):
            a, rows = first + k, rows + 1
            assert [row[b] for b in range(a + 1, 90)] == [len(np.intersect1d(sets[a], sets[b])) for b in range(a + 1, 90)]
    assert rows == 90


def test_buckets_split_between_tasks_give_the_same_groups(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = near_copies.near_copies(docs, block_hashes=2000).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.component_fp, r.doc_id)
    assert set(first.values()) == plain_kept(texts) and len(rows) == len(texts)


def test_stars_over_parts_of_a_key():
    import numpy as np
    import pyarrow as pa

    def batch(keys, fps):
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in (keys, fps)], ["key", "fp"])

    parts = [batch([], []), batch([1, 1, 2], [5, 6, 9]), batch([2, 3], [8, 4]), batch([3], [7])]
    got = [tuple(r.values()) for b in near_copies.stars(iter(parts)) for r in b.to_pylist()]
    assert sorted(got) == [(1, 5, 5), (1, 5, 6), (2, 9, 8), (3, 4, 4), (3, 4, 7)]
    assert not list(near_copies.stars(iter(parts[:1])))


def test_fingerprints_find_what_bands_are_kept_from(spark, monkeypatch):
    """The stage has op4's method: what differs in 2 or fewer bits is found by fingerprints alone, and checked exactly."""
    from storyloom.llm.simhash import fingerprint

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    texts = [" ".join(word() for _ in range(300)) for _ in range(12)]
    texts += [t + " " + word() for t in texts]
    texts += ["x " * 200 + " ".join(word() for _ in range(20)) for _ in range(2)]  # equal fingerprints, other sets
    bits = lambda a, b: (fingerprint(texts[a], 5) ^ fingerprint(texts[b], 5)).bit_count() if a != b else 0
    near = [k for k in range(12) if bits(k, k + 12) <= 2]
    assert len(near) >= 6 and bits(24, 25) == 0
    monkeypatch.setattr(near_copies, "stars", lambda batches: iter(()))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert got == set(range(len(texts))) - {k + 12 for k in near}
