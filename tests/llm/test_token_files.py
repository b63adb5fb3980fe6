import random
import zlib

import numpy as np
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm import token_files as m
from storyloom.llm.packing import default_vocabulary


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=700), st.sampled_from([1, 2, 8]), st.sampled_from([1, 3]))
def test_blocks_decode_from_every_checkpoint(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    table = m.Table(m.normalise(np.bincount(ids, minlength=301)))
    words, points = m.encode(ids, table, lanes, every)
    ends = [w for w, _ in points[1:]] + [len(words)]
    step = lanes * every
    assert len(points) == -(-len(ids) // step)
    for k, ((w, states), e) in enumerate(zip(points, ends, strict=True)):
        part = ids[k * step : (k + 1) * step]
        assert m.decode(states, words[w:e], len(part), table).tolist() == part.tolist()


def test_frequencies_add_up():
    rng = np.random.default_rng(1)
    for counts in ([5], [0, 1, 0], rng.integers(0, 3, 60_000), np.r_[10**15, np.ones(60_000)], np.r_[np.ones(1 << 20)]):
        f = m.normalise(np.array(counts))
        assert f.sum() == 1 << m.BITS and ((f > 0) == (np.array(counts) > 0)).all()
    assert m.normalise(np.zeros(3)).sum() == 0
    with pytest.raises(ValueError):
        m.normalise(np.ones((1 << 20) + 1))


def test_size_is_near_the_entropy():
    ids = np.random.default_rng(2).zipf(1.3, 200_000).clip(max=50_000).astype(np.uint32)
    counts = np.bincount(ids)
    words, _ = m.encode(ids, m.Table(m.normalise(counts)), 256, 256)
    p = counts[counts > 0] / len(ids)
    assert 32 * len(words) < 1.01 * len(ids) * -(p * np.log2(p)).sum() + 256 * 64


def plain(rows):
    """By the vocabulary's own library, one row at a time."""
    from tokenizers import Tokenizer

    own, out, start = Tokenizer.from_file(default_vocabulary()[0]), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def rows_of(docs, uri, id_type="long", **options):
    manifest = m.write_tokens(docs, uri, **options)
    found = m.read_tokens(manifest, uri, id_type, segments=3, with_ids=True)
    return manifest, sorted((tuple(r) for r in found.collect()), key=lambda r: (r[1], r[2]))


def test_round_trip_with_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    words = ["a", " the", "Straße", "!", "\n", "日本", "🙂", "<|endoftext|>", " 12345"]
    rows = [(rng.randint(-5, 10**12), "".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [(7, None), (8, ""), (None, "no id"), (9, " ".join(["very long"] * 40_000)), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS ids", "2 AS n", "3 AS uid").repartition(3)
    small = dict(lanes=4, segment=64, block=256)
    manifest, found = rows_of(docs, f"file://{tmp_path}/a", **small)
    assert found == [(*r[:4], r[4]) for r in plain(rows)]
    assert sum(r.n_docs for r in manifest.collect()) == len(rows) and manifest.count() > 1
    # Files in order hold ascending ids.
    low = [r.file for r in manifest.orderBy("part").collect()]
    table = m.Table(np.frombuffer((tmp_path / "a/table.bin").read_bytes(), "<u4"))
    ids = [x for f in low for x in m.FileReader(pyarrow.fs.LocalFileSystem(), f"{tmp_path}/a/{f}", table).ids.to_pylist()]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_texts_as_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x y"), ("a", "z")], "doc_id string, text string")
    _, found = rows_of(docs, f"file://{tmp_path}/s", "string")
    assert [r[:2] for r in found] == [("a", 0), ("b", 2)]
    manifest, found = rows_of(docs.limit(0), f"file://{tmp_path}/e", "string")
    assert found == [] and manifest.count() == 0


def test_a_changed_byte_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(k, "some words to keep " * 20) for k in range(20)], "doc_id long, text string").coalesce(1)
    manifest = m.write_tokens(docs, f"file://{tmp_path}", file_ids=10**9)
    row = manifest.first()
    table = m.Table(np.frombuffer((tmp_path / "table.bin").read_bytes(), "<u4"))
    path = tmp_path / row.file
    whole = path.read_bytes()
    local = pyarrow.fs.LocalFileSystem()
    assert len(list(m.FileReader(local, str(path), table).documents(0, row.n_segments))) == row.n_docs
    for at in (m.HEAD_BYTES + 1, len(whole) - 100, 9):
        path.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(ValueError):
            list(m.FileReader(local, str(path), table).documents(0, row.n_segments))


def test_files_of_failed_tasks_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(50)], "doc_id long, text string")
    uri = f"file://{tmp_path}"
    manifest = m.write_tokens(docs, uri)
    (tmp_path / "left.tok").write_bytes(b"half a file")
    assert m.read_tokens(manifest, uri).count() == 50
