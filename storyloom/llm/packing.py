"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Each document becomes its token ids and one end id. Only documents longer than the capacity
are cut: full pieces fill a sequence by themselves, and the remainder (the first piece) is
packed with the remainders of others. Items are dealt by hash to shards of about
``shard_items``, so each task holds a bounded number of them; every shard is evolved by
several islands. An island keeps a small population of whole packings: crossover injects whole
well-filled bins of one parent into another, removes the bins that hold duplicates, and
best-fits the displaced documents, largest first. Between epochs the elite of each island
migrates to the next of its shard. An island ends early at the lower bound on bins. Each shard's
least filled sequence is given up and its items are packed again with those of the other shards, in
shards of their own, until there is one: so not every shard keeps a sequence that isn't full.

The vocabulary is read on the driver and broadcast (two files of a fixed size).

Defined results: a null or empty text is one piece of the end id alone. Repeated rows are
packed each by itself. Equal lengths are told apart by a row number that is written before
packing, so retried tasks repeat the same packing. An empty table packs into nothing. Only
the named columns are read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import one_thread, per_worker, received, send, table
from storyloom.shared import materialize

VOCABULARY = "byte_bpe_50k.json"
#: Its ranks in another library's format; ids are the same, and several times as fast.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


def read_files(*paths: str) -> list[bytes]:
    found = []
    for path in paths:
        with open(path, "rb") as f:
            found.append(f.read())
    return found


class Encoder:
    """Ids of a text as the vocabulary's own library gives them, without special tokens added.

    The ranks give the same ids for ordinary text; a text that holds the special token's
    string goes through the vocabulary's library, which reads it as that token.
    """

    def __init__(self, vocabulary: bytes, ranks: bytes) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        one_thread()
        self.vocabulary, self.whole = vocabulary, None
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_buffer(self.vocabulary)
        return self.whole.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str, ranks: str, with_ids: bool):
    """A row per piece: id, text_hash, piece, start, length, ids_crc32 (and ids)."""
    source = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    files = read_files(vocabulary, ranks)
    held, key = send(docs.sparkSession, files), f"encoder {zlib.crc32(files[0])} {zlib.crc32(files[1])}"
    schema = (
        f"id {dict(source.dtypes)['id']}, text_hash long, piece int, start long, length long, ids_crc32 long"
        + ", ids array<int>" * with_ids
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = per_worker(key, lambda: Encoder(*received(held)))
        for b in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                ids = np.array([*encoder.ids(text.as_py() or ""), end_id], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    if with_ids:
                        kept.append(ids[s : s + n].astype(np.int32))
            at = pa.array(row, pa.int32())
            columns = [b.column("id").take(at), b.column("text_hash").take(at), pa.array(piece, pa.int32()),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "text_hash", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


class Packing:
    """Bins under construction, found by their free space in constant time."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0  # bit f: some bin has f free

    def _list(self, k: int) -> None:
        f = self.free[k]
        self.by_free[f].append(k)
        self.open |= 1 << f

    def add_bin(self, items: list[int], free: int) -> None:
        self.bins.append(items)
        self.free.append(free)
        if free:
            self._list(len(self.bins) - 1)

    def best_fit(self, items) -> None:
        sizes, by_free, free = self.sizes, self.by_free, self.free
        for i in items:
            s = sizes[i]
            room = self.open >> s
            if room:
                f = s + (room & -room).bit_length() - 1
                k = by_free[f].pop()
                if not by_free[f]:
                    self.open ^= 1 << f
                self.bins[k].append(i)
                free[k] = f - s
                if f > s:
                    self._list(k)
            else:
                self.add_bin([i], self.capacity - s)

    def fitness(self) -> tuple[float, float]:
        """Fewer bins first, then fuller ones (mean square fill)."""
        c = self.capacity
        return -len(self.bins), sum(((c - f) / c) ** 2 for f in self.free) / max(1, len(self.bins))


def lower_bound(sizes: list[int], capacity: int) -> int:
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def from_bins(bins: list[list[int]], sizes: list[int], capacity: int) -> Packing:
    p = Packing(sizes, capacity)
    for b in bins:
        p.add_bin(list(b), capacity - sum(sizes[i] for i in b))
    return p


def crossover(first: Packing, second: Packing, rng) -> Packing:
    """Whole well-filled bins of second go into first; bins with duplicates go, the displaced
    documents are best-fitted, largest first."""
    sizes, capacity = first.sizes, first.capacity
    good = sorted(range(len(second.bins)), key=lambda k: second.free[k])
    good = [k for k in good[: max(1, len(good) * 3 // 4)] if rng.random() < 0.5] or good[:1]
    child, injected, displaced = Packing(sizes, capacity), set(), []
    for k in good:
        child.add_bin(list(second.bins[k]), second.free[k])
        injected.update(second.bins[k])
    for k, b in enumerate(first.bins):
        if injected.isdisjoint(b):
            child.add_bin(list(b), first.free[k])
        else:
            displaced += [i for i in b if i not in injected]
    child.best_fit(sorted(displaced, key=lambda i: -sizes[i]))
    return child


def mutate(p: Packing, rng) -> Packing:
    """Dissolves the least filled bins and a few others, and best-fits their documents again."""
    order = sorted(range(len(p.bins)), key=lambda k: -p.free[k])
    gone = set(order[: max(2, len(order) // 50)]) | {k for k in order if rng.random() < 0.02}
    child, displaced = Packing(p.sizes, p.capacity), []
    for k, b in enumerate(p.bins):
        if k in gone:
            displaced += b
        else:
            child.add_bin(list(b), p.free[k])
    child.best_fit(sorted(displaced, key=lambda i: -p.sizes[i]))
    return child


def evolve(sizes: list[int], capacity: int, population: list[Packing], seed: int, generations: int, members: int):
    """The population after some generations, best first."""
    import random

    rng, bound = random.Random(seed), lower_bound(sizes, capacity)
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while len(population) < members:
        # Decreasing best fit first; the others from orders disturbed more and more.
        noise = 0.1 * len(population)
        order = down if not population else sorted(down, key=lambda i: -sizes[i] * (1 - noise * rng.random()))
        p = Packing(sizes, capacity)
        p.best_fit(order)
        population.append(p)
        if len(p.bins) <= bound:
            break
    population.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(population[0].bins) <= bound:
            break
        a, b = rng.choice(population), rng.choice(population)
        child = mutate(crossover(a, b, rng) if a is not b else a, rng)
        if child.fitness() > population[-1].fitness():
            population[-1] = child
            population.sort(key=Packing.fitness, reverse=True)
    return population


def assignment(p: Packing) -> bytes:
    import numpy as np

    out = np.empty(len(p.sizes), np.int32)
    for k, b in enumerate(p.bins):
        out[b] = k
    return out.tobytes()


def from_assignment(raw: bytes, sizes: list[int], capacity: int) -> Packing:
    import numpy as np

    bins: list[list[int]] = []
    for i, k in enumerate(np.frombuffer(raw, np.int32).tolist()):
        while len(bins) <= k:
            bins.append([])
        bins[k].append(i)
    return from_bins(bins, sizes, capacity)


ISLAND = "shard long, island int, uids binary, lengths binary, packings array<binary>, bins int"


def found_island(capacity: int, generations: int, members: int):
    def run(key, batch):
        import numpy as np

        items = batch.sort_by("uid")
        uids, lengths = items.column("uid").to_numpy(), items.column("length").to_numpy()
        return island_row(key[0].as_py(), key[1].as_py(), uids.astype(np.int64), lengths.astype(np.int32), [],
                          0, capacity, generations, members)

    return run


def next_epoch(capacity: int, generations: int, members: int, epoch: int):
    """Over an island's own row and the elite of its neighbour (a row without packings of its own)."""

    def run(key, batch):
        import numpy as np

        rows = sorted(batch.to_pylist(), key=lambda r: r["bins"] < 0)
        own = rows[0]
        packings = [p for r in rows for p in r["packings"]]
        return island_row(key[0].as_py(), key[1].as_py(), np.frombuffer(own["uids"], np.int64),
                          np.frombuffer(own["lengths"], np.int32), packings, epoch, capacity, generations, members)

    return run


def island_row(shard, island, uids, lengths, packings, epoch, capacity, generations, members):
    import pyarrow as pa

    sizes = lengths.tolist()
    population = [from_assignment(p, sizes, capacity) for p in packings]
    population = evolve(sizes, capacity, population, hash((shard, island, epoch)), generations, members)[:members]
    return pa.table(
        [pa.array([shard], pa.int64()), pa.array([island], pa.int32()), pa.array([uids.tobytes()], pa.binary()),
         pa.array([lengths.tobytes()], pa.binary()), pa.array([[assignment(p) for p in population]], pa.list_(pa.binary())),
         pa.array([len(population[0].bins)], pa.int32())],
        ["shard", "island", "uids", "lengths", "packings", "bins"],
    )


def unpack(capacity: int, level: int):
    """A row per item of each shard's best packing: uid, length, sequence, offset in it, and whether it is in
    the shard's least filled one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                uids, lengths = np.frombuffer(r["uids"], np.int64), np.frombuffer(r["lengths"], np.int32)
                bins = np.frombuffer(r["best"], np.int32)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order].astype(np.int64))
                starts = ends - lengths[order]
                first = np.concatenate(([True], np.diff(bins[order]) != 0))
                offset = starts - np.maximum.accumulate(np.where(first, starts, 0))
                fill = np.bincount(bins, lengths)
                loose = bins[order] == fill.argmin() if fill.min() < capacity else np.zeros(len(bins), bool)
                sequence = (np.int64(level) << 56) | (np.int64(r["shard"]) << 32) | bins[order].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[order]), pa.array(lengths[order].astype(np.int64)), pa.array(sequence), pa.array(offset), pa.array(loose)],
                    ["uid", "length", "sequence_id", "offset", "loose"],
                )

    return run


def place(items: DataFrame, capacity: int, shard_items: int, islands: int, members: int, epochs: int, generations: int, level: int = 0) -> DataFrame:
    """(uid, sequence_id, offset) of items (uid, length)."""
    shards = max(1, -(-items.count() // shard_items))
    dealt = items.select(
        F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), "uid", "length",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
    )
    state = materialize(
        dealt.groupBy("shard", "island").applyInArrow(found_island(capacity, generations, members), ISLAND), "islands"
    )
    for epoch in range(1, epochs):
        elite = state.select(
            "shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.lit(None).cast("binary").alias("uids"),
            F.lit(None).cast("binary").alias("lengths"), F.slice("packings", 1, 1).alias("packings"), F.lit(-1).alias("bins"),
        )
        step = next_epoch(capacity, generations, members, epoch)
        state = materialize(state.unionAll(elite).groupBy("shard", "island").applyInArrow(step, ISLAND), "islands")
    best = state.groupBy("shard").agg(
        F.min_by(F.struct("uids", "lengths", F.col("packings")[0].alias("best")), F.struct("bins", "island")).alias("s")
    )
    schema = "uid long, length long, sequence_id long, offset long, loose boolean"
    placed = best.select("shard", "s.*").mapInArrow(unpack(capacity, level), schema)
    columns = ["uid", "sequence_id", "offset"]
    if shards == 1:
        return placed.select(columns)
    placed = materialize(placed, "places")
    again = place(placed.where("loose").select("uid", "length"), capacity, shard_items, islands, members, epochs, generations, level + 1)
    return placed.where("not loose").select(columns).unionAll(again)


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
    vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False, shard_items: int = 8192,
    islands: int = 2, members: int = 4, epochs: int = 2, generations: int = 12,
) -> DataFrame:
    """A row per piece: id_col, text_hash, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    standard = default_vocabulary() if not (vocabulary and ranks) else ("", "")
    pieces = materialize(
        tokenise(docs, id_col, text_col, capacity, end_id, vocabulary or standard[0], ranks or standard[1], with_ids)
        .withColumn("uid", F.monotonically_increasing_id()),
        "pieces",
    )
    short = pieces.where(F.col("length") < capacity).select("uid", "length")
    places = place(short, capacity, shard_items, islands, members, epochs, generations)
    packed = pieces.where(F.col("length") < capacity).join(places, "uid")
    full = pieces.where(F.col("length") >= capacity).select(
        "*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = [c for c in pieces.columns if c not in ("uid", "id")]
    return packed.unionByName(full).select(F.col("id").alias(id_col), *rest, "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("text_hash")
