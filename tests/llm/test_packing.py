import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storyloom.llm import packing as m

ENCODER = m.Encoder(*m.read_files(*m.default_vocabulary()))
PLAIN = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.sampled_from(["<|endoftext|>", "a <|endoftext|> b", "  \n\n \t x", "don't WON'T", "é́ ½ ١٢", "  x"]))
def test_ids_are_the_vocabularys(text):
    assert ENCODER.ids(text) == PLAIN.encode(text, add_special_tokens=False).ids


def check(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.text_hash), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for items in by_sequence.values():
        at = 0
        for r in sorted(items, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = {}
    for i, text in docs:
        ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append(ids)
    for (i, _), pieces in by_doc.items():
        found = [ids for ids in want[i] if len(pieces) % max(1, -(-len(ids) // capacity)) == 0 and all(
            zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in pieces)]
        assert found
        assert all(p.length == capacity for p in pieces if p.piece > 0)
    assert sum(r.length for r in rows) == sum(len(x) for ids in want.values() for x in ids)
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packs_everything_tightly(spark):
    rng = random.Random(6)
    docs = [(k, "word " * rng.choice([1, 5, 30, 60, 61, 64, 90, 200, 700])) for k in range(400)] + [(1000, None), (1001, ""), (None, "null id"), (7, "again"), (7, "again")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS uid", "3 AS piece").repartition(3)
    rows = m.pack(d, capacity=64, shard_items=100).collect()
    n, bound = check(rows, docs, 64)
    # Three shards end with a sequence that isn't full at worst.
    assert n <= bound + 6


def test_empty_table_and_only_full_pieces(spark):
    assert m.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = m.pack(spark.createDataFrame([(1, "a" * 0 + " word" * 7)], "doc_id long, text string"), capacity=8, with_ids=True).collect()
    assert [(r.piece, r.start, r.length, r.offset, len(r.ids)) for r in rows] == [(0, 0, 8, 0, 8)]


def test_crossover_and_mutation_keep_every_item_once():
    import random as rnd

    rng = rnd.Random(7)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    first, second = m.Packing(sizes, 64), m.Packing(sizes, 64)
    first.best_fit(range(300))
    second.best_fit(sorted(range(300), key=lambda i: -sizes[i]))
    for child in (m.crossover(first, second, rng), m.mutate(first, rng), m.from_assignment(m.assignment(first), sizes, 64)):
        assert sorted(i for b in child.bins for i in b) == list(range(300))
        assert all(sum(sizes[i] for i in b) + f == 64 for b, f in zip(child.bins, child.free, strict=True))


def test_evolution_improves_on_its_founders():
    rng = random.Random(8)
    # Triples that fill a bin exactly, which decreasing best fit doesn't find.
    sizes = []
    for _ in range(60):
        a = rng.randint(26, 40)
        b = rng.randint(26, 99 - a - 25)
        sizes += [a, b, 100 - a - b]
    founder = m.Packing(sizes, 100)
    founder.best_fit(sorted(range(180), key=lambda i: -sizes[i]))
    best = m.evolve(sizes, 100, [], 1, 300, 6)[0]
    assert len(best.bins) <= len(founder.bins) and best.fitness() > founder.fitness()


def test_many_shards_share_their_last_sequences(spark):
    rng = random.Random(16)
    docs = [(k, "word " * rng.choice([1, 5, 9, 30])) for k in range(600)]
    rows = m.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), capacity=64, shard_items=25).collect()
    n, bound = check(rows, docs, 64)
    assert n <= bound + 3  # 24 shards
