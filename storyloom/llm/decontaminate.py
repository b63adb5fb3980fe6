"""Benchmark decontamination by a broadcast hash set of normalised word windows.

Plan: the benchmark's windows of 13 words become a hash set that is broadcast; one pass over
the documents scans every window of every whole text. A benchmark of more than ``block_windows``
windows is streamed and scanned block by block: a block's hits are written before the next block
is made, and its broadcast is destroyed, so that one block of fixed size is held at a time, on the
driver and on executors. Only the first pass returns all documents, the others those with hits, and
the hits are merged. An item of more windows than a block is split between blocks.

A scan looks at the runs of words that the block's vocabulary knows, finds candidates by a
rolling hash over the run, and verifies each candidate against the window's words.

Defined results: a null or empty text has no words, hits nothing and is clean. Items without
words give no window. Equal windows of several items hit for each of them. Repeated rows are
scanned each by itself. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import received, send, table, utf8
from storyloom.shared import materialize

#: A-Z to a-z; bytes below 0x80 that are neither letters nor digits to spaces.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def folded_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class WindowSet:
    """Windows of one block of the benchmark, by hash, and the item that each is from."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        self.parts: dict[int, list] = {}
        self.windows: dict[int, tuple] = {}  # by length: hashes in order, word numbers, items
        self.size = 0

    def add(self, item: str, words: list[bytes], n: int) -> None:
        """The windows of n words (or the whole, if there are fewer)."""
        import numpy as np

        ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
        found = np.lib.stride_tricks.sliding_window_view(ids, min(n, len(ids)))
        self.parts.setdefault(found.shape[1], []).append((found, len(self.names)))
        self.names.append(item)
        self.size += len(found)

    def freeze(self) -> "WindowSet":
        import numpy as np

        for n, parts in self.parts.items():
            rows = np.concatenate([p for p, _ in parts])
            items = np.repeat(np.array([k for _, k in parts], np.int32), [len(p) for p, _ in parts])
            hashes = np.concatenate([rolling(rows[k : k + 65536].astype(np.uint64), n)[:, 0] for k in range(0, len(rows), 65536)])
            order = np.argsort(hashes, kind="stable")
            self.windows[n] = hashes[order], rows[order], items[order]
        self.parts = {}
        return self

    def scan(self, words: list[bytes]):
        """(start, length, items) of each occurrence of a window."""
        import numpy as np

        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int32, len(words))
        known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            run = ids[start:end]
            for n, (hashes, rows, items) in self.windows.items():
                if end - start < n:
                    continue
                found = rolling(run[None, :].astype(np.uint64), n)[0]
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                for p in np.flatnonzero(hashes[at] == found).tolist():
                    last = np.searchsorted(hashes, found[p], side="right")
                    same = (rows[at[p] : last] == run[p : p + n]).all(axis=1)
                    if same.any():
                        yield start + p, n, {self.names[k] for k in np.unique(items[at[p] : last][same]).tolist()}


def rolling(rows, n: int):
    """Polynomial hash, modulo 2**64, of each window of n ids in each row."""
    import numpy as np

    width = rows.shape[1] - n + 1
    out = np.zeros((rows.shape[0], width), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(BASE) + rows[:, k : k + width] * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
    return out


def window_blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_windows: int):
    """Window sets of at most block_windows windows, read as a stream of items; there is always one."""
    block, blocks = WindowSet(), 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        words = folded_words(text)
        last = max(1, len(words) - n + 1) if words else 0  # the item's windows
        first = 0
        while first < last:
            if block.size == block_windows:
                yield block.freeze()
                block, blocks = WindowSet(), blocks + 1
            take = min(last - first, block_windows - block.size)
            block.add("" if item is None else item, words[first : first + take + n - 1], n)
            first += take
    if block.size or not blocks:
        yield block.freeze()


SCHEMA = "id {id}, text_hash long, n_words long, starts array<int>, ends array<int>, items array<string>"


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", n: int = 13, block_windows: int = 1_000_000,
) -> DataFrame:
    """Per row of docs: its words, the word spans [start, end) inside windows of the benchmark
    (merged, in order), and the items whose windows occur.

    Returns id_col, text_hash, n_words, n_hit, starts, ends, items.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    schema = SCHEMA.format(id=dict(source.dtypes)["id"])
    blocks = window_blocks(benchmark, item_col, item_text_col, n, block_windows)
    held, following = send(spark, next(blocks)), next(blocks, None)
    out = source.mapInArrow(scanner(held), schema)
    if following is not None:
        passes = [materialize(out, "hits").withColumn("is_first", F.lit(True))]
        while following is not None:
            held.destroy()
            held = send(spark, following)
            hits = source.mapInArrow(scanner(held), schema).where(F.size("starts") > 0)
            passes.append(materialize(hits, "hits").withColumn("is_first", F.lit(False)))
            following = next(blocks, None)
        held.destroy()
        both = passes[0]
        for p in passes[1:]:
            both = both.unionAll(p)
        # Repeated rows have equal hits, so merging them by row identity and then restoring
        # their number keeps each of them.
        merged = both.groupBy("id", "text_hash").agg(
            F.max("n_words").alias("n_words"),
            F.count_if("is_first").cast("int").alias("copies"),
            F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("starts", "ends")))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
        out = merged.select(
            "id", "text_hash", "n_words", F.array_sort("spans").alias("spans"), F.array_sort("items").alias("items"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        ).select("id", "text_hash", "n_words", "spans.starts", "spans.ends", "items")
        out = out.mapInArrow(merge_spans, schema)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(F.col("id").alias(id_col), "text_hash", "n_words", hit.alias("n_hit"), "starts", "ends", "items")


def union_of(spans):
    """Sorted, overlapping or touching [start, end) as disjoint ones."""
    starts, ends = [], []
    for s, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def scanner(held):
    def scan(batches):
        import pyarrow as pa

        windows = received(held)
        for batch in batches:
            n_words, all_starts, all_ends, all_items = [], [], [], []
            for text in batch.column("text"):
                words = folded_words(text.as_py())
                spans, items = [], set()
                for start, length, names in windows.scan(words):
                    spans.append((start, start + length))
                    items |= names
                starts, ends = union_of(sorted(spans))
                n_words.append(len(words))
                all_starts.append(starts)
                all_ends.append(ends)
                all_items.append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(n_words, pa.int64()),
                 pa.array(all_starts, pa.list_(pa.int32())), pa.array(all_ends, pa.list_(pa.int32())),
                 pa.array(all_items, pa.list_(pa.string()))],
                ["id", "text_hash", "n_words", "starts", "ends", "items"],
            )

    return scan


def merge_spans(batches):
    import pyarrow as pa

    for batch in batches:
        merged = [
            union_of(sorted(zip(s, e, strict=True)))
            for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_hash"), batch.column("n_words"),
             pa.array([m[0] for m in merged], pa.list_(pa.int32())),
             pa.array([m[1] for m in merged], pa.list_(pa.int32())), batch.column("items")],
            ["id", "text_hash", "n_words", "starts", "ends", "items"],
        )


def contaminated(n_hit, n_words, per_hit: int = 20):
    """Whether a twentieth or more of the words are hit."""
    return (n_hit > 0) & (per_hit * n_hit >= n_words)


def remove_spans(text: str | None, starts: list[int], ends: list[int]) -> str:
    """The text without the hit words and what stands between the words of a span."""
    import re

    text = text or ""
    at = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    out, last = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join([*out, text[last:]])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, bw.item_id, dw.i, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
