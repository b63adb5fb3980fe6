"""Near copies of documents by word shingles: SimHash and MinHash bands for candidates, exact Jaccard for links.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more; groups are the components of these links. Every link is verified on the whole shingle sets, as hashes of 64 bits.

First come op4's fingerprints and deletion variants (simhash): each fingerprint meets the smallest that differs in 2 or
fewer bits, and pairs whose texts are similar become groups. Fingerprints can't find all: at 0.8 some 10
of 64 bits differ and up to 21 would have to be allowed for, so one of 11 segments of 6 bits would differ by at most
one bit, and every key would hold a thirty-second of the corpus. So what isn't in a group together yet meets in one of 32 bands of 4 minimum
hashes, too: a pair at exactly 0.8 is missed with a chance of (1 - 0.8 ** 4) ** 32, or 5e-8, and a
closer pair with less.

Texts with equal sets are one class before anything is compared. In a bucket, first every class
meets one pivot, another in each band, so a large group of near copies becomes a component by
linearly many comparisons. Then buckets whose members are still in different components are compared whole, in a
task each, as long as they have at most ``block_hashes`` shingles. Larger ones are cut, in the order of the texts'
sizes, into blocks of so many (or one text's), each written to a file once. Every two blocks whose sizes
allow for the similarity meet in a task, which reads their files: no pair is left out, none is a row, and no
shingle is shuffled again for a pair. There, texts with too many shingles that no other text of
the two blocks has are left out first, as they can't reach the similarity; of the others common
shingles are counted, and links that join components leave the task. Only buckets of many texts of like size that
resemble but don't link take time, and reading, with the square of their size. Files are read and written
through pyarrow.fs; those that a failed task leaves are in no table, and never read.

Defined results: a text of fewer words than a shingle has one shingle; null and empty texts have
none and are equal to each other. Repeated rows get equal results. Only the named columns are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.simhash import closest, fingerprint_of, shingle_hashes
from storyloom.llm.warc import file_system
from storyloom.operators.components import connected_components
from storyloom.shared import materialize, new_path

BANDS, ROWS = 32, 4


def shingle_set(text: str | None, n: int = 5):
    """The sorted distinct hashes of a text's n-word shingles."""
    import numpy as np

    return np.unique(shingle_hashes(text, n))


def band_keys(hashes):
    """A key for each band of a set's minimum hashes; an empty set has keys of its own."""
    import numpy as np

    rng = np.random.default_rng(42)
    flips = rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
    odd = rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 1024):
        x = (hashes[k : k + 1024, None] ^ flips) * odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, x.min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def classes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, text_hash, fp, n, mark, keys) for each row; fp tells sets of n shingles apart, mark is the text's fingerprint."""
    source = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text")
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for b in batches:
            fps, sizes, marks, keys = [], [], [], []
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), n)
                marks.append(fingerprint_of(h))
                s = np.unique(h)
                sizes.append(len(s))
                fps.append(xxh3_64_intdigest(s.tobytes()))
                keys.append(band_keys(s))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            out = [b.column("id"), b.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                   pa.array(marks, pa.int64()), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(out, ["id", "text_hash", "fp", "n", "mark", "keys"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, text_hash long, fp long, n long, mark long, keys array<long>")


def fingerprint_pairs(marked: DataFrame) -> DataFrame:
    """(a, b) of classes (fp, mark) with a < b: each with the first of its fingerprint, and these with the first of the
    smallest fingerprint in 2 or fewer bits. As many rows as classes at most."""
    first = materialize(marked.groupBy("mark").agg(F.min("fp").alias("first")), "marks")
    equal = marked.join(first, "mark").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    of = lambda end: first.select(F.col("mark").alias(end), F.col("first").alias(f"first_{end}"))
    near = closest(first.select(F.col("mark").alias("fp"))).join(of("a"), "a").join(of("b"), "b")
    return equal.unionAll(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def stars(batches):
    """Over a range of rows sorted by key: (key, a, b) from the first fingerprint of each key to each other one.

    A task's first and last key may go on in its neighbours: their first fingerprints are linked to
    themselves, too.
    """
    import numpy as np
    import pyarrow as pa

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["key", "a", "b"])

    edge = last = None
    for batch in batches:
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(keys):
            continue
        new = np.concatenate(([last is None or keys[0] != last[0]], np.diff(keys) != 0))
        at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        first = fps[np.maximum(at, 0)]
        if last is not None:
            first[at < 0] = last[1]
        else:
            edge = keys[0]
            yield out(keys[:1], fps[:1], fps[:1])
        last = (keys[-1], first[-1])
        other = first != fps
        yield out(keys[other], first[other], fps[other])
    if last is not None and last[0] != edge:
        yield out([last[0]], [last[1]], [last[1]])


def reaches(common, total, similarity: float):
    """Whether sets of total elements, counted in each, with so many common ones are similar."""
    return common >= similarity * (total - common) - 1e-9


def common_counts(owner, inverse, df, m: int, dense_df: int = 32, strip: int = 256):
    """(first row, counts of common elements with all m sets) for strips of sets; owner and inverse
    tell the set and the element of each occurrence, df the sets of each element.

    Frequent elements are counted by matrix products, others by their pairs of sets.
    """
    import numpy as np

    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    starts = np.concatenate(([0], np.cumsum(df)[:-1]))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(2, min(dense_df, m) + 1):
        at = starts[df == d]
        if len(at):
            sets = owner[at[:, None] + np.arange(d)]
            p, q = np.triu_indices(d, 1)
            left.append(sets[:, p].ravel())
            right.append(sets[:, q].ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    left, right = np.minimum(left, right), np.maximum(left, right)
    by_left = np.argsort(left, kind="stable")
    left, right = left[by_left], right[by_left]
    frequent = np.flatnonzero(df > dense_df)
    column = np.full(len(df), -1)
    column[frequent] = np.arange(len(frequent))
    at = column[inverse]
    owner, at = owner[at >= 0], at[at >= 0]
    for k in range(0, m, strip):
        n = min(strip, m - k)
        s, e = np.searchsorted(left, [k, k + n])
        counts = np.bincount((left[s:e] - k) * m + right[s:e], minlength=n * m).reshape(n, m).astype(np.float32)
        for c in range(0, len(frequent), 1024):  # occurrences are in the order of elements
            s, e = np.searchsorted(at, [c, c + 1024])
            x = np.zeros((m, min(1024, len(frequent) - c)), np.float32)
            x[owner[s:e], at[s:e] - c] = 1
            counts += x[k : k + n] @ x.T
        yield k, counts


def across(similarity: float):
    """For two blocks of a bucket (sub tells them apart), or one: links between similar sets of different components, as
    many as join these, not one for each pair."""

    def run(rows):
        import numpy as np
        import pyarrow as pa

        rows = rows.combine_chunks()
        fps, comps, sub = (rows.column(c).to_numpy() for c in ("fp", "component", "sub"))
        hashes = rows.column("hashes").combine_chunks()
        sizes = np.diff(hashes.offsets.to_numpy())
        flat = hashes.flatten().to_numpy()
        owner = np.repeat(np.arange(len(fps)), sizes)
        _, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.bincount(owner[df[inverse] > 1], minlength=len(fps))
        able = np.flatnonzero((shared >= similarity * sizes - 1e-9) & (sizes > 0))
        out_a, out_b = [], []
        if len(np.unique(comps[able])) > 1:
            place = np.full(len(fps), -1)
            place[able] = np.arange(len(able))
            held = place[owner] >= 0
            _, inverse, df = np.unique(flat[held], return_inverse=True, return_counts=True)
            fps, comps, sub, sizes, m = fps[able], comps[able], sub[able], sizes[able], len(able)
            two = len(np.unique(rows.column("sub").to_numpy())) > 1
            root = np.unique(comps, return_inverse=True)[1]
            for first, counts in common_counts(place[owner[held]], inverse, df, m):
                near = reaches(counts, sizes[first : first + len(counts), None] + sizes[None, :], similarity)
                for k in np.flatnonzero(near.any(axis=1)).tolist():
                    a = first + k
                    js = np.flatnonzero(near[k])
                    js = js[(js > a) & (root[js] != root[a])]
                    if two:
                        js = js[sub[js] != sub[a]]
                    if not len(js):
                        continue
                    others, at = np.unique(root[js], return_index=True)
                    out_a += [fps[a]] * len(at)
                    out_b += fps[js[at]].tolist()
                    root[np.isin(root, others)] = root[a]
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def block_writer(uri: str, block_hashes: int):
    """Writes rows (key, n, fp, component, hashes), sorted so far, to a file for each block of a key: of about block_hashes
    hashes, or one set. Returns key, file, the least and the largest size, and the only component or null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        fs, root = file_system(uri)
        held, size = [], 0

        def done():
            rows = pa.concat_tables(held)
            name = f"{uuid.uuid4().hex}.block"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out, pa.ipc.new_stream(out, rows.schema) as w:
                w.write_table(rows.combine_chunks())
            sizes, comps = rows.column("n").to_numpy(), rows.column("component").to_numpy()
            only = comps[0] if (comps == comps[0]).all() else None
            row = [rows.column("key")[0].as_py(), name, int(sizes.min()), int(sizes.max()), only]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["key", "file", "low", "high", "only"])

        last = None
        for b in batches:
            rows, keys = pa.Table.from_batches([b]), b.column("key").to_numpy()
            cuts = np.flatnonzero(np.diff(keys) != 0) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if at == end:
                    continue
                if held and (keys[at] != last or size >= block_hashes):
                    yield done()
                    held, size = [], 0
                last = keys[at]
                sizes = b.column("n").to_numpy()[at:end]
                full = np.flatnonzero(np.diff((size + np.cumsum(sizes)) // block_hashes)) + 1
                for x, y in zip([0, *full.tolist()], [*full.tolist(), end - at], strict=True):
                    if x and held:
                        yield done()
                        held, size = [], 0
                    held.append(rows.slice(at + x, y - x))
                    size += int(sizes[x:y].sum())
        if held:
            yield done()

    return run


def block_comparer(uri: str, similarity: float):
    """Reads the two blocks of each row (x, y), or the one, and returns the links that join components."""
    compare = across(similarity)

    def run(batches):
        import pyarrow as pa

        fs, root = file_system(uri)

        def read(name, sub):
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                rows = pa.ipc.open_stream(f).read_all()
            return rows.append_column("sub", pa.array([sub] * rows.num_rows, pa.int32()))

        for b in batches:
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                found = compare(read(x, 0) if x == y else pa.concat_tables([read(x, 0), read(y, 1)]))
                yield from found.to_batches()

    return run


def similar(similarity: float):
    """Rows (a, b) whose sets have that Jaccard similarity at least."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x, y = b.column("set_a"), b.column("set_b")
            keep = np.zeros(len(b), bool)
            for k in range(len(b)):
                s, t = x[k].values.to_numpy(), y[k].values.to_numpy()
                if min(len(s), len(t)) >= similarity * max(len(s), len(t)):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep[k] = reaches(common, len(s) + len(t), similarity)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def shingle_sets(docs: DataFrame, firsts: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(fp, hashes) for each fp of wanted, from the text of the first of its rows (fp, s: none, id, text_hash)."""
    rows = firsts.join(wanted, "fp", "left_semi").select("fp", F.col("s.id").alias("r_id"), F.col("s.text_hash").alias("r_hash"))
    texts = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text")
    ).join(rows, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t.as_py(), n).view("int64") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(sets, pa.list_(pa.int64()))], ["fp", "hashes"])

    found = texts.groupBy("fp").agg(F.max("text").alias("text"))
    return found.mapInArrow(run, "fp long, hashes array<long>")


def _across_blocks(rows: DataFrame, similarity: float, block_hashes: int) -> DataFrame:
    """Links (a, b) in buckets of any size, by files of blocks that are written once and read for each block they meet."""
    spark = rows.sparkSession
    uri = new_path(spark, "blocks")
    fs, root = file_system(uri)
    fs.create_dir(root, recursive=True)
    # By size in each bucket: blocks whose sizes are too far apart never meet.
    ordered = rows.repartitionByRange("key", "n", "fp").sortWithinPartitions("key", "n", "fp")
    blocks = materialize(ordered.mapInArrow(block_writer(uri, block_hashes), "key long, file string, low long, high long, only long"), "blocks")
    x = blocks.select("key", F.col("file").alias("x"), F.col("low").alias("low_x"), F.col("high").alias("high_x"), F.col("only").alias("only_x"))
    y = blocks.select("key", F.col("file").alias("y"), F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("only").alias("only_y"))
    sized = (F.col("high_x") >= similarity * F.col("low_y") - 1e-9) & (F.col("high_y") >= similarity * F.col("low_x") - 1e-9)
    one = F.coalesce(F.col("only_x") == F.col("only_y"), F.lit(False))
    pairs = materialize(x.join(y, "key").where((F.col("x") <= F.col("y")) & sized & ~one).select("x", "y"), "pairs")
    n = pairs.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    return pairs.repartitionByRange(min(n, 64 * spark.sparkContext.defaultParallelism), "x", "y").mapInArrow(block_comparer(uri, similarity), "a long, b long")


def near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8,
    block_hashes: int = 500_000,
) -> DataFrame:
    """Per row of docs: id_col, text_hash (tells rows of one id apart), fp (equal sets of shingles),
    component_fp (tells groups apart)."""
    each = materialize(classes(docs, id_col, text_col, shingle_words), "classes")
    # A row per class, summed up before the shuffle; what follows never meets the rows of a large class again.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("s")
    firsts = materialize(each.groupBy("fp").agg(first, F.first("n").alias("n"), F.min("mark").alias("mark"), F.first("keys").alias("keys")), "firsts")
    keys = firsts.select("fp", F.explode("keys").alias("key"))
    # A range of keys a task, so that a key which very many share is split, a pivot for each part; these meet the least of theirs.
    order = ["key", F.xxhash64("fp", "key")]
    met = materialize(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stars, "key long, a long, b long"), "stars")
    parts = met.where("a = b").select("key", F.min("a").over(Window.partitionBy("key")).alias("a"), "b")
    met = met.where("a <> b").unionAll(materialize(parts.where("a <> b"), "parts"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return materialize(shingle_sets(docs, firsts, wanted, id_col, text_col, shingle_words), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        sets = sets_of(pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp"))).distinct())
        both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("set_a")), "a").join(
            sets.select(F.col("fp").alias("b"), F.col("hashes").alias("set_b")), "b"
        )
        return materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(similar(similarity), "a long, b long"), "links")

    # What fingerprints find, each checked; bands needn't compare what is in one group already.
    close = linked(materialize(fingerprint_pairs(firsts.select("fp", "mark")), "marked"))
    group = materialize(connected_components(close, "a", "b"), "groups")
    of = lambda end: group.select(F.col("id").alias(end), F.col("component").alias(f"group_{end}"))
    apart = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.where(~F.coalesce(F.col("group_a") == F.col("group_b"), F.lit(False))).select("a", "b")
    links = close.unionAll(linked(materialize(apart, "pairs")))
    found = connected_components(links, "a", "b")
    # Buckets of one class have no star; the others' classes are the ends of theirs and the least pivot.
    sizes = firsts.select("fp", "n")
    ends = met.select("key", F.col("b").alias("fp")).unionAll(met.groupBy("key").agg(F.min("a").alias("fp")))
    members = ends.join(sizes, "fp").join(found.withColumnRenamed("id", "fp"), "fp", "left")
    members = materialize(members.select("key", "fp", "n", F.coalesce("component", "fp").alias("component")), "members")
    in_key = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n").alias("total")
    )
    mixed = in_key.where("m > 2 and x <> y").select("key", (F.col("total") > block_hashes).alias("large"))
    rest = materialize(members.join(mixed, "key"), "members")
    if not rest.isEmpty():
        sets = sets_of(rest.select("fp").distinct())
        rows = rest.join(sets, "fp").select("key", "n", "fp", "component", "hashes", "large")
        more = rows.where("not large").select("key", F.lit(0).alias("sub"), "fp", "component", "hashes").groupBy("key").applyInArrow(across(similarity), "a long, b long")
        more = more.unionAll(_across_blocks(rows.where("large").drop("large"), similarity, block_hashes))
        more = materialize(more, "links")
        if not more.isEmpty():
            found = connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more), "a", "b")
    return each.join(found.withColumnRenamed("id", "fp"), "fp", "left").select(
        F.col("id").alias(id_col), "text_hash", "fp", F.coalesce("component", "fp").alias("component_fp")
    )
