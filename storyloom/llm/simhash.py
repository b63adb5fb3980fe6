"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are linked at 2 or fewer differing bits of 64. Cut into 2 segments of 32 bits,
one segment differs by at most one bit. Each distinct fingerprint is indexed under its first
segment with each bit made a wildcard (32 variants); where the first segment takes both
differing bits, the second is equal, so one exact key of the second segment covers the rest.
Equal keys meet by a range shuffle on key and fingerprint, so that a key which very many share is
split between tasks, and fingerprints that share a key are verified on all 64 bits.
A pair is reported under one key only: the wildcard at its differing bit.

Copies never meet as pairs: documents are grouped by fingerprint first (partial aggregation).
A key with more than ``max_bucket`` distinct fingerprints isn't verified pair by pair: its
members get a second wildcard (32 variants, or 496 where the key's segment is equal), under
which all members are within 2 bits of each other, so linking each to the smallest keeps every
component. Rows of such a key are streamed, never collected. The keys at a task's ends, which may go
on in its neighbours, are treated alike, whatever their size.

Defined results: a null or empty text has fingerprint zero, linked like any other. Repeated
rows get equal results. Rows with a null id get their class; a class of null ids only has a
null component. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import table, words
from storyloom.operators.components import connected_components
from storyloom.shared import materialize

SEED = 42
HALF = 0xFFFFFFFF


def shingle_hashes(text: str | None, n: int = 3):
    """XXH64 of each n-word shingle, repeats included; fewer words make one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= n:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[: -n] + 1)).tolist()
    return np.fromiter(
        (xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=True)),
        np.uint64, len(starts),
    )


def fingerprint(text: str | None, n: int = 3) -> int:
    """Signed 64-bit fingerprint of a text's shingles."""
    return fingerprint_of(shingle_hashes(text, n))


def fingerprint_of(h) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half the hashes."""
    import numpy as np

    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        part = np.ascontiguousarray(h[k : k + 8192]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """(id, text_hash, fp) for each row."""
    source = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), n) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), fps], ["id", "text_hash", "fp"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, text_hash long, fp long")


def variant_keys(batches):
    """33 keys for each fingerprint: kind 0-31, the first segment with that bit cleared; kind
    32, the second segment."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        low, high = fp & np.uint64(HALF), fp >> np.uint64(32)
        kinds = np.arange(32, dtype=np.uint64)
        keys = (low[:, None] & ~(np.uint64(1) << kinds)[None, :]) | (kinds << np.uint64(32))[None, :]
        keys = np.concatenate([keys, (high | np.uint64(32 << 32))[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, 33).view(np.int64))], ["key", "fp"]
        )


def verify(max_bucket: int):
    """Over a range of rows sorted by key: links of pairs in small buckets (key -1), rows of others, and of
    the first and last key, as they are."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(keys, a, b):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(x, np.int64)) for x in (keys, a, b)], ["key", "a", "b"]
            )

        def links(keys, fps):
            for lag in range(1, max_bucket):
                same = np.flatnonzero(keys[lag:] == keys[:-lag])
                if not len(same):
                    return
                a, b, kind = fps[same], fps[same + lag], keys[same] >> 32
                x = (a ^ b).view(np.uint64)
                in_low = np.bitwise_count(x & np.uint64(HALF))
                # The one key that reports the pair: at its differing bit of the first segment,
                # at bit 0 if there is none, or at the second segment if both are in the first.
                at = np.where(in_low == 2, 32, np.where(in_low == 1, np.bitwise_count((x & np.uint64(HALF)) - np.uint64(1)), 0))
                ok = (np.bitwise_count(x) <= 2) & (at == kind)
                if ok.any():
                    yield out(np.full(ok.sum(), -1), a[ok], b[ok])

        keys, fps, hot = np.empty(0, np.int64), np.empty(0, np.int64), None
        begun = False
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if not len(keys):
                continue
            if not begun:
                hot, begun = keys[0], True
            starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            large = sizes > max_bucket
            if hot is not None and keys[0] == hot:
                large[0] = True
            hot = keys[-1] if large[-1] else None
            emit = np.repeat(large, sizes)
            if emit.any():
                yield out(keys[emit], fps[emit], fps[emit])
            rest = np.repeat(~large, sizes)
            tail = 0 if large[-1] else int(sizes[-1])
            done = rest.copy()
            if tail:
                done[-tail:] = False
            yield from links(keys[done], fps[done])
            keys, fps = (keys[-tail:], fps[-tail:]) if tail else (keys[:0], fps[:0])
        yield out(keys, fps, fps)

    return run


def second_variants(batches):
    """For rows of large buckets: the fingerprint with two bits cleared, and which two."""
    import numpy as np
    import pyarrow as pa

    one = np.uint64(1)
    within = [(p, q) for p in range(32) for q in range(p + 1, 32)]
    plans = {
        **{k: [(k, 32 + q) for q in range(32)] for k in range(32)},
        32: within,
    }
    plans[0] = plans[0] + [(32 + p, 32 + q) for p, q in within]
    for b in batches:
        kinds, fps = b.column("key").to_numpy() >> 32, b.column("a").to_numpy().view(np.uint64)
        for kind in np.unique(kinds).tolist():
            fp = fps[kinds == kind]
            for k in range(0, len(plans[kind]), 64):
                pairs = plans[kind][k : k + 64]
                masks = np.array([~((one << np.uint64(p)) | (one << np.uint64(q))) for p, q in pairs], np.uint64)
                pattern = np.array([p * 64 + q for p, q in pairs], np.int64)
                masked = (fp[:, None] & masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(pattern, len(fp))), pa.array(masked.view(np.int64)),
                     pa.array(np.repeat(fp, len(pairs)).view(np.int64))],
                    ["pattern", "masked", "fp"],
                )


def link_to_first(batches):
    """Over rows sorted by (pattern, masked, fp): links each row to the first of its group."""
    import numpy as np
    import pyarrow as pa

    last = None
    for b in batches:
        p, m, fp = (b.column(c).to_numpy() for c in ("pattern", "masked", "fp"))
        if not len(p):
            continue
        new = np.concatenate(([True], (np.diff(p) != 0) | (np.diff(m) != 0)))
        first = fp[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        if last is not None and last[:2] == (p[0], m[0]):
            head = int(np.argmax(new[1:]) + 1) if new[1:].any() else len(p)
            first[:head] = last[2]
        last = (p[-1], m[-1], first[-1])
        keep = first != fp
        yield pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array(fp[keep])], ["a", "b"])


def fingerprint_links(distinct: DataFrame, max_bucket: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs at 2
    or fewer differing bits."""
    found = materialize(
        distinct.mapInArrow(variant_keys, "key long, fp long")
        .repartitionByRange("key", "fp")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(verify(max_bucket), "key long, a long, b long"),
        "links",
    )
    second = (
        found.where("key >= 0")
        .mapInArrow(second_variants, "pattern long, masked long, fp long")
        .repartition("pattern", "masked")
        .sortWithinPartitions("pattern", "masked", "fp")
        .mapInArrow(link_to_first, "a long, b long")
    )
    return found.where("key < 0").select("a", "b").unionAll(second)


def closest(distinct: DataFrame) -> DataFrame:
    """(a, b): each distinct fingerprint b with the smallest a that it is linked to, if that is smaller.

    As many rows as fingerprints at most, of pairs at 2 or fewer differing bits, for a check on the texts to follow.
    """
    links = fingerprint_links(distinct).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.where("a < b").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bucket: int = 64) -> DataFrame:
    """Per row of docs: id_col, text_hash (tells rows of one id apart), fp, component_fp (tells groups
    apart), component_id (the smallest id reachable over links, itself included).

    Texts by the similarity of their sets of shingles are near_copies' work, which begins with these fingerprints.
    """
    each = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = each.groupBy("fp").agg(F.min("id").alias("first"))
    found = connected_components(fingerprint_links(classes.select("fp"), max_bucket), "a", "b")
    labelled = (
        classes.join(found.withColumnRenamed("id", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(smallest, "component").select("fp", F.col("component").alias("component_fp"), "component_id")
    return each.join(by_fp, "fp").select(F.col("id").alias(id_col), "text_hash", "fp", "component_fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
