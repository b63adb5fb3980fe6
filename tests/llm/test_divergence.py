import random
import re
from collections import Counter

import pytest

from storyloom.llm import divergence as m

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=3, top=200):
    """Every weight of every group for every kept term."""
    docs = [(lang or "", source or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= min_docs}

        def weights(texts):
            counts = Counter(t for d in texts for t in d[2] if t in kept)
            total = sum(counts.values())
            return counts, {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        whole = weights(own)[1]
        groups = {s: weights([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (counts, p) in groups.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, (_, q) in groups.items() if o != s]
            terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "'x' AS item", "3 AS v")
    return sorted(tuple(r) for r in m.source_divergence(docs.repartition(3), **options).collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "The", "été", "É", "x1y", "don't", "日本", "\x00nul", "Zz", "q" * 300] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choice(words[: rng.randint(3, 30)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", None, "ß", "s3"])) for _ in range(n)]
    rows += [("only here", "fr", "one"), (None, "fr", "one"), ("", "es", "none"), ("1 2 3", "es", "other")]  # no kept terms
    rows += [("Repeated row", "it", "a")] * 4 + [("row row", "it", "b"), ("and long " * 30_000, "it", "b"), (" ", "it", "c")]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_rows": 20, "held_rows": 10, "slice_bytes": 200, "top": 4}])
def test_matches_plain_version(spark, options):
    rows = corpus(3)
    assert run(spark, rows, **options) == plain(rows, top=options.get("top", 200))


def test_one_source_with_most_rows(spark):
    rng = random.Random(5)
    rows = [(f"hot term {rng.choice('abcdef')} {rng.choice('ghij')}", "en", "hot" if k % 3 else f"s{k % 7}") for k in range(300)]
    assert run(spark, rows, shard_rows=5, min_docs=1) == plain(rows, min_docs=1)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_numbers_beyond_64_bits_within_a_shard():
    con = m.connect()
    con.execute("CREATE TABLE rows AS SELECT 'en' AS lang, 'a' AS source, 't' AS term, 20000000000 AS n, 30000000000 AS lang_n, "
                "20000000000 AS total, 40000000000 AS lang_total, 1 AS v")  # fmt: skip
    con.execute(m.WEIGHTS)
    assert con.execute("SELECT p, z, q FROM w").fetchall() == [(1 + 10**9, 1, 1 + 10**9 * (3 * 10**10 + 1) // (4 * 10**10 + 1))]


def test_nothing_is_written_to_disk():
    con = m.connect("20MB")
    with pytest.raises(Exception, match="(?i)memory"):
        con.execute("CREATE TABLE t AS SELECT range AS a, hash(range) AS b FROM range(20000000)")
