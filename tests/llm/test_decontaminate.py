import random
import re

import pytest

from storyloom.llm import decontaminate as m

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, n=13):
    windows = {}
    for i, text in items:
        w = fold(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, found = fold(text), set(), set()
        for window, held in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= held
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS starts", "2 AS id").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS items")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in m.benchmark_hits(d, b, **options).collect()), key=repr)


@pytest.mark.parametrize("block", [1_000_000, 5])
def test_matches_plain_version(spark, block):
    rng = random.Random(2)
    words = ["a", "B", "c3", "dé", "e,f", "g"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 13, 16])))) for k in range(12)]
    items += [(50, None), (51, " ,. "), (None, "g g g g"), (52, items[4][1]), (52, items[4][1])]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(30)]
    docs += [(k + 100, f"Before; {items[k][1].upper() if k % 2 else items[k][1]} -- after") for k in range(12)]
    docs += [(200, None), (201, ""), (None, "g g g g"), (100, docs[30][1]), (100, docs[30][1]), (202, " ".join(["a b"] * 5000))]
    assert run(spark, docs, items, block_windows=block) == plain(docs, items)


def test_blocks_are_bounded_and_one_broadcast_lives(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    items = [(1, " ".join(words)), (2, " ".join(words[5:25])), (3, "x y")]  # 48 windows, 8 and 1
    docs = [(1, " ".join(["a", *words[3:30], "b"])), (2, " ".join(words[40:52])), (3, "x y")]
    table = spark.createDataFrame(items, "item_id long, text string")
    sizes = [b.size for b in m.window_blocks(table, "item_id", "text", 13, 10)]
    assert sizes == [10, 10, 10, 10, 10, 7]
    alive, most, kept = set(), [], m.send

    def send(session, value):
        held = kept(session, value)
        alive.add(held)
        most.append(len(alive))
        destroy = held.destroy
        held.destroy = lambda *a: (alive.discard(held), destroy(*a))
        return held

    monkeypatch.setattr(m, "send", send)
    assert run(spark, docs, items, block_windows=10) == plain(docs, items)
    assert len(most) == 6 and max(most) == 1 and not alive


def test_no_benchmark_and_no_documents(spark):
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]
    assert run(spark, [], [(1, "a b")]) == []


def test_rule_and_spans(spark):
    assert m.remove_spans("One, two; THREE four.", [1], [3]) == "One,  four."
    docs = spark.createDataFrame([(1, 20), (1, 21), (0, 0)], "n_hit long, n_words long")
    from pyspark.sql import functions as F

    assert [r[0] for r in docs.select(m.contaminated(F.col("n_hit"), F.col("n_words"))).collect()] == [True, False, False]
