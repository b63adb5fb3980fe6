import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def plain_components(first_by_fp):
    fps = sorted(first_by_fp)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    best = {}
    for f in fps:
        r = find(f)
        best[r] = min(best.get(r, first_by_fp[f]), first_by_fp[f])
    return {f: best[find(f)] for f in fps}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB é\n\t\x0b\xa0İ.", max_size=60))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_long_text_is_fingerprinted_whole():
    text = " ".join(f"w{i % 977}" for i in range(30000))
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize("max_bucket", [2, 8, 64])
def test_links_give_the_components_of_all_pairs(spark, max_bucket):
    rng = random.Random(max_bucket)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):  # balls: chains of one to three changed bits, in either half or both
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << p) for p in range(64)}
    fps |= {centre ^ (1 << p) ^ (1 << q) for p in range(0, 64, 5) for q in range(1, 64, 3) if p != q}
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), max_bucket)
    from storyloom.operators.components import connected_components

    got = {r.id & (2**64 - 1): r.component for r in connected_components(links, "a", "b").collect()}
    want = plain_components({f & (2**64 - 1): f for f in signed})
    linked = {f for f in want if sum(want[f] == v for v in want.values()) > 1}
    assert got == {f: want[f] for f in linked}


def test_a_key_that_many_share_is_split_between_tasks(spark):
    """Fingerprints with one second segment, and with one first segment, over tasks of a few rows."""
    rng = random.Random(3)
    half = rng.getrandbits(32)
    fps = {half << 32 | rng.getrandbits(12) for _ in range(200)} | {rng.getrandbits(12) << 32 | half for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 64).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
        root[find(a)] = find(b)
    want = plain_components({f & (2**64 - 1): f for f in signed})
    groups = {}
    for f in signed:
        groups.setdefault(find(f), set()).add(want[f & (2**64 - 1)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_nulls_ties_copies_and_clashing_columns(spark):
    rows = [(5, None, "x"), (3, "", "y"), (None, "One two three four", "z"), (9, "one TWO three four", "z"),
            (9, "one TWO three four", "z"), (2, "quite another text here", "z")]
    docs = spark.createDataFrame(rows, SCHEMA + ", fp string").withColumnRenamed("fp", "component")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 9), (2, 2), (3, 3), (5, 3), (9, 9), (9, 9)]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
