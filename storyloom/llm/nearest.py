"""Approximate nearest neighbours by balanced posting lists (cosine).

1. There is a list for every ``list_rows`` vectors, ``max_lists`` at most (beyond, lists grow; what is
   broadcast, centroids and their neighbour graph, is bounded). Centroids are fitted on a bounded sample
   (``sample_rows``): repeated median cuts, then rounds in which every centroid moves to the middle of
   the vectors nearest to it and lists of over twice the mean size are cut up, for which thin ones go.
2. Every vector goes to the posting list of its nearest centroid, and boundary vectors also to
   others that are nearly as near (``closure`` times the distance) and that no chosen centroid is
   nearer to, ``replicas`` lists at most. Centroids are found by best-first search in the graph with
   a beam, never by comparing a vector with all of them.
3. A query walks the same graph with a beam of ``width`` centroids and searches the lists whose centroids
   are at most ``ratio`` times as far as the nearest. Both are calibrated: for a part of the
   sample (``sample_queries``) the true neighbours among all rows are found by brute force, and
   ratio and width are the least (the width in steps of an eighth) that find ``target`` of these. So
   few lists are searched in clustered data and many in scattered data.
4. Neighbouring lists are dealt to shards of about ``block_rows`` vectors; larger lists are split.
   A query goes once to every shard that holds one of its lists, and a shard's queries are dealt to
   blocks of ``block_rows``, too: no task holds more than a block of each, however many vectors
   crowd around one centroid. Each gives a query's best, with scores in double precision from the
   original vectors, and these are merged. A query for which fewer than k were found searches all lists.

Equal vectors are searched once: of each class of equal candidates only the k + 1 with the
smallest ids can be among anyone's k nearest (cut before the shuffle), and equal queries share one
search.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or
differ in dimension from most take no part, nor do null ids. Repeated rows of one id and vector
count once. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import received, send, table
from storyloom.shared import discard, materialize


def unit(x):
    import numpy as np

    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(column):
    """(rows, dimension) of a list column, in double precision."""
    import numpy as np

    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def median_cells(x, rows, m: int, rng) -> list:
    """rows dealt to m cells of equal size by cuts across the main direction; neighbours are adjacent."""
    import numpy as np

    if m < 2 or len(rows) < 2:
        return [rows]
    part = x[rows] - x[rows].mean(axis=0)
    axis = rng.normal(size=x.shape[1])
    for _ in range(8):
        axis = part.T @ (part @ axis)
        axis /= np.linalg.norm(axis) + 1e-30
    by = rows[np.argsort(part @ axis, kind="stable")]
    at = max(1, len(rows) * (m // 2) // m)
    return median_cells(x, by[:at], m // 2, rng) + median_cells(x, by[at:], m - m // 2, rng)


def centre_of(x, rows):
    """The direction of the medians, or the first vector's if there is none. Medians, as a few scattered
    vectors in a crowded cell mustn't draw its centre away."""
    import numpy as np

    middle = np.median(x[rows], axis=0)
    n = np.linalg.norm(middle)
    return middle / n if n > 1e-6 else x[rows[0]]


class Index:
    """Centroids, their neighbour graph, and the searches in it."""

    def __init__(self, sample, n_lists: int, degree: int = 16, rounds: int = 8, seed: int = 1) -> None:
        import numpy as np

        x, rng = unit(sample).astype(np.float32), np.random.default_rng(seed)
        centres = np.stack([centre_of(x, c) for c in median_cells(x, np.arange(len(x)), n_lists, rng)])
        for _ in range(rounds):
            near = np.concatenate([(x[i : i + 1024] @ centres.T).argmax(axis=1) for i in range(0, len(x), 1024)])
            order = np.argsort(near, kind="stable")
            size = np.bincount(near, minlength=len(centres))
            members = np.split(order, np.cumsum(size)[:-1])
            for k in np.flatnonzero(size):
                centres[k] = centre_of(x, members[k])
            full = np.flatnonzero(size > 2 * size.mean())
            thin = [k for k in np.argsort(-size, kind="stable").tolist() if size[k] < size.mean()][-len(centres) // 4 :]
            if not len(full):
                break
            for k in full[np.argsort(-size[full], kind="stable")].tolist():
                m = min(int(-(-size[k] // size.mean())), 1 + len(thin))
                for at, c in zip([k, *(thin.pop() for _ in range(m - 1))], median_cells(x, members[k], m, rng), strict=True):
                    centres[at] = centre_of(x, c)
        # Lists near each other get numbers near each other, so that shards hold neighbours.
        self.centres = centres[np.concatenate(median_cells(centres, np.arange(len(centres)), len(centres), rng))]
        self.graph = self._graph(degree, rng)
        # Entry points far from each other, so that every part of the graph is reached.
        entries = [0]
        while len(entries) < min(8, len(centres)):
            entries.append(int((self.centres @ self.centres[entries].T).max(axis=1).argmin()))
        self.entries = np.array(entries)
        self.ratio, self.floor, self.width = float("inf"), 1e-6, len(centres)
        self.compared = 0  # centroids that searches of this object have looked at

    def _graph(self, degree: int, rng):
        """Each centroid's nearest, the next by number and one anywhere, so that no part is cut off."""
        import numpy as np

        c, k = self.centres, len(self.centres)
        near = []
        for i in range(0, k, 256):
            s = -(c[i : i + 256] @ c.T)
            s[np.arange(len(s)), np.arange(i, i + len(s))] = np.inf
            n = min(degree, k - 1)
            near.append(np.argpartition(s, n - 1, axis=1)[:, :n] if n else np.empty((len(s), 0), int))
        near = np.concatenate(near)
        own = np.arange(k)
        for other in ((own + 1) % k, rng.integers(0, k, k)):
            # A neighbour that is there already is replaced by the centroid itself, which is always seen.
            other = np.where((near == other[:, None]).any(axis=1), own, other)
            near = np.concatenate([near, other[:, None]], axis=1)
        return near.astype(np.int32)

    def _distances(self, x, at):
        import numpy as np

        s = np.matmul(self.centres[at], x[:, :, None])[:, :, 0]
        self.compared += at.size
        return np.sqrt(np.maximum(0, 2 - 2 * s))

    def search(self, x, width: int):
        """Best-first search with a beam: (lists, distances), nearest first, for unit rows x; infinite
        distances stand for none."""
        import numpy as np

        if len(x) > 1024:  # the centroids that are looked at take a multiple of x's memory
            parts = [self.search(x[i : i + 1024], width) for i in range(0, len(x), 1024)]
            return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
        n, k, x = len(x), len(self.centres), np.asarray(x, np.float32)
        width = min(width, k)
        if width == k:
            d = np.sqrt(np.maximum(0, 2 - 2 * x @ self.centres.T))
            self.compared += d.size
            at = np.argsort(d, axis=1, kind="stable")
            return at, np.take_along_axis(d, at, 1)
        seen = np.zeros((n, k), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).astype(np.int32)
        dist = self._distances(x, ids)
        opened = np.zeros(ids.shape, bool)
        while True:
            waiting = np.where(opened, np.inf, dist)
            nxt = waiting.argmin(axis=1)
            rows = np.flatnonzero(np.isfinite(waiting[np.arange(n), nxt]))
            if not len(rows):
                break
            opened[rows, nxt[rows]] = True
            near = np.broadcast_to(np.int32(0), (n, self.graph.shape[1])).copy()
            near[rows] = self.graph[ids[rows, nxt[rows]]]
            new = np.zeros(near.shape, bool)
            new[rows] = ~seen[rows[:, None], near[rows]]
            seen[rows[:, None], near[rows]] = True
            r, c = np.nonzero(new)
            further = np.full(near.shape, np.inf, np.float32)
            further[r, c] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x[r], self.centres[near[r, c]])))
            self.compared += len(r)
            ids, dist = np.concatenate([ids, near], axis=1), np.concatenate([dist, further], axis=1)
            opened = np.concatenate([opened, ~new], axis=1)
            if ids.shape[1] > width:
                keep = np.argpartition(dist, width - 1, axis=1)[:, :width]
                ids, dist, opened = (np.take_along_axis(a, keep, 1) for a in (ids, dist, opened))
        at = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, at, 1), np.take_along_axis(dist, at, 1)

    def postings(self, x, replicas: int, closure: float):
        """(row, list) pairs: the nearest list, and those of boundary vectors."""
        import numpy as np

        at, d = self.search(x, max(16, 4 * replicas))
        at, d = at[:, : 4 * replicas], d[:, : 4 * replicas]
        rows, lists = [np.arange(len(x))], [at[:, 0]]
        chosen = [(np.ones(len(x), bool), at[:, 0])]
        count = np.ones(len(x), int)
        for j in range(1, at.shape[1]):
            ok = (d[:, j] <= closure * d[:, 0]) & np.isfinite(d[:, j]) & (count < replicas)
            for is_one, c in chosen:
                between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.centres[at[:, j]], self.centres[c])))
                ok &= ~is_one | (between > d[:, j])
            chosen.append((ok, at[:, j]))
            count += ok
            rows.append(np.flatnonzero(ok))
            lists.append(at[ok, j])
        return np.concatenate(rows), np.concatenate(lists)

    def probes(self, x):
        """(row, list) pairs that queries search."""
        import numpy as np

        at, d = self.search(x, self.width)
        rows, j = np.nonzero(self._in_reach(d))
        return rows, at[rows, j]

    def _in_reach(self, d):
        import numpy as np

        return (d <= self.ratio * np.maximum(d[:, :1], self.floor)) & np.isfinite(d)

    def calibrate(self, queries, owner, neighbours, target: float, replicas: int, closure: float) -> float:
        """Sets ratio and width to the least that find target of the true neighbours (of query owner);
        returns the share found."""
        import numpy as np

        q, x = unit(queries), unit(neighbours)
        rows, lists = self.postings(x, replicas, closure)
        exact = np.sqrt(np.maximum(0, 2 - 2 * q.astype(np.float32) @ self.centres.T))
        nearest = exact.min(axis=1)
        self.floor = max(1e-6, float(np.quantile(nearest, 0.01)) / 2)
        relative = exact / np.maximum(nearest, self.floor)[:, None]
        need = np.full(len(x), np.inf)
        np.minimum.at(need, rows, relative[owner[rows], lists])
        # The ratio takes half of what may be missed, the beam the rest.
        self.ratio = float(np.quantile(need, (1 + target) / 2, method="higher")) * (1 + 1e-6)
        self.width = len(self.centres)
        member = np.zeros((len(x), len(self.centres)), bool)
        member[rows, lists] = True

        def found(width: int) -> float:
            at, d = self.search(q, width)
            probed = np.zeros((len(q), len(self.centres)), bool)
            np.put_along_axis(probed, at, self._in_reach(d), 1)
            return float((member & probed[owner]).any(axis=1).mean())

        width = 16
        while width < len(self.centres):
            if (share := found(width)) >= target:
                self.width = width
                return share
            width += -(-width // 8)
        return found(self.width)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, repeated rows once. Vectors of floats stay such."""
    v = F.col("v")
    good = (
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    kind = "float" if dict(rows.dtypes)[vector_col] == "array<float>" else "double"
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(good)
    # Zeros of either sign are one vector.
    return named.withColumn("v", F.transform("v", lambda x: (x + F.lit(0.0)).cast(kind)))


def assigned(index_held, replicas: int, closure: float):
    """Rows (vec_id, v) to postings (list, vec_id, v)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        index = received(index_held)
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                rows, lists = index.postings(unit(vectors(part.column("v"))), replicas, closure)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), part.column("vec_id").take(at), part.column("v").take(at)], ["list", "vec_id", "v"]
                )

    return run


@dataclass
class Shards:
    """Which shard each list is in, and how many parts the shard has."""

    of: object
    parts: object

    @classmethod
    def plan(cls, sizes, block_rows: int) -> "Shards":
        """Lists in order fill shards; one of more than a block has a shard of its own."""
        import numpy as np

        of, held = np.zeros(len(sizes), np.int32), []
        for k, n in enumerate(sizes.tolist()):
            if not held or held[-1] + n > block_rows:
                held.append(0)
            held[-1] += n
            of[k] = len(held) - 1
        return cls(of, np.maximum(1, -(-np.array(held) // block_rows)).astype(np.int32))


def probing(index_held, shards_held, every: bool):
    """Queries (vec_id, v) to (shard, sub, vec_id, v, lists): a row per part of a shard that holds lists to
    search; with every, all lists."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        index, shards = received(index_held), received(shards_held)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                x = unit(vectors(part.column("v")))
                if every:
                    n = len(index.centres)
                    rows, lists = np.repeat(np.arange(len(x)), n), np.tile(np.arange(n), len(x))
                else:
                    rows, lists = index.probes(x)
                order = np.lexsort((lists, rows))
                rows, lists = rows[order], lists[order].astype(np.int32)
                shard = shards.of[lists]
                cuts = np.flatnonzero(np.concatenate(([True], (np.diff(rows) != 0) | (np.diff(shard) != 0)))) if len(rows) else np.empty(0, int)
                times = shards.parts[shard[cuts]]  # each part of the shard has the same lists
                sub = np.concatenate([np.arange(t) for t in times]) if len(times) else np.empty(0, int)
                groups = np.repeat(np.arange(len(cuts)), times)
                found = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(rows)).astype(np.int32)), pa.array(lists)).take(pa.array(groups))
                at = pa.array(rows[cuts][groups], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cuts][groups]), pa.array(sub.astype(np.int32)), part.column("vec_id").take(at), part.column("v").take(at), found],
                    ["shard", "sub", "vec_id", "v", "lists"],
                )

    return run


def top_of(q, ids, scores, keep: int):
    """Positions of the best of each q (ties to smaller ids), each id once."""
    import numpy as np

    order = np.lexsort((ids, -scores, q))
    same = (np.diff(q[order]) == 0) & (np.diff(ids[order]) == 0)
    order = order[np.concatenate(([True], ~same))] if len(order) else order
    r = q[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r, side="left") < keep]


def best_of_block(keep: int):
    """For a part of a shard's postings and a block of its queries: each query's best in its lists."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        q, c, s = ([np.empty(0, t)] for t in (np.int64, np.int64, np.float64))
        ids = qs = np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("list").combine_chunks(), right.combine_chunks()
            held, ids = left.column("list").to_numpy(), left.column("vec_id").to_numpy()
            a, b = vectors(left.column("v").combine_chunks()), vectors(right.column("v").combine_chunks())
            qs = right.column("vec_id").to_numpy()
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            ua, ub = a / na[:, None], b / nb[:, None]
            lists = right.column("lists").combine_chunks()
            wanted = lists.flatten().to_numpy()
            asking = np.repeat(np.arange(len(qs)), np.diff(lists.offsets.to_numpy()))
            by = np.argsort(wanted, kind="stable")
            wanted, asking = wanted[by], asking[by]
            for k in np.unique(held).tolist():
                first, last = np.searchsorted(held, [k, k + 1])
                f, t = np.searchsorted(wanted, [k, k + 1])
                for at in range(f, t, 256):
                    rows = asking[at : min(at + 256, t)]
                    sim = ub[rows] @ ua[first:last].T
                    m = min(keep, sim.shape[1])
                    floor = np.partition(sim, sim.shape[1] - m, axis=1)[:, sim.shape[1] - m] - 1e-9
                    i, j = np.nonzero(sim >= floor[:, None])
                    i, j = rows[i], first + j
                    # The score of a pair doesn't depend on the block it was found in.
                    exact = (b[i] * a[j]).sum(axis=1) / (nb[i] * na[j])
                    q.append(i)
                    c.append(j)
                    s.append(exact)
        q, c, s = (np.concatenate(x) for x in (q, c, s))
        best = top_of(q, ids[c] if len(c) else c, s, keep)
        names = ["query_id", "vec_id", "score"]
        return pa.table([pa.array(qs[q[best]], pa.int64()), pa.array(ids[c[best]], pa.int64()), pa.array(s[best], pa.float64())], names)

    return run


def search(postings: DataFrame, probes: DataFrame, shards: Shards, keep: int, block_rows: int) -> DataFrame:
    """(query_id, found: the best (cost, vec_id) structs) by meeting of posting and query blocks."""
    spark = postings.sparkSession
    asked = probes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    # Both tables have a row per list at most, of which there are max_lists.
    of = spark.createDataFrame([(k, int(s), int(shards.parts[s])) for k, s in enumerate(shards.of)], "list int, shard int, subs int")
    of = F.broadcast(of.join(F.broadcast(asked), "shard"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = postings.join(of, "list").select("shard", F.pmod(F.xxhash64("vec_id"), "subs").cast("int").alias("sub"), every, "list", "vec_id", "v")
    right = probes.join(F.broadcast(asked), "shard").select(
        "shard", "sub", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v", "lists"
    )
    keys = ["shard", "sub", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_of_block(keep), "query_id long, vec_id long, score double")
    # At most keep rows for each block that a query has searched; the same vector may be in several.
    return found.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("cost"), "vec_id"))), 1, keep).alias("found")
    )


def true_neighbours(candidates: DataFrame, ids, queries, k: int) -> tuple:
    """(query number, vector) of the k nearest of a few queries among all candidates, by brute force: each
    partition gives its best, of which the best are collected."""
    import numpy as np

    held = send(candidates.sparkSession, (np.asarray(ids), unit(queries)))

    def run(batches):
        import pyarrow as pa

        own, asked = received(held)
        best = None
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                s = asked @ unit(vectors(part.column("v"))).T
                s[part.column("vec_id").to_numpy()[None, :] == own[:, None]] = -2
                q, c = np.nonzero(s >= np.partition(s, s.shape[1] - min(k, s.shape[1]), axis=1)[:, [s.shape[1] - min(k, s.shape[1])]])
                found = pa.table([pa.array(q), part.column("vec_id").take(pa.array(c)), pa.array(s[q, c]), part.column("v").take(pa.array(c))], ["q", "vec_id", "score", "v"])
                found = found if best is None else pa.concat_tables([best, found])
                at = top_of(*(found.column(x).to_numpy() for x in ("q", "vec_id", "score")), k)
                best = found.take(pa.array(at)).combine_chunks()
        if best is not None:
            yield from best.to_batches()

    schema = f"q long, vec_id {dict(candidates.dtypes)['vec_id']}, score double, v {dict(candidates.dtypes)['v']}"
    window = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = candidates.select("vec_id", "v").mapInArrow(run, schema).withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= k)
    out = found.where("score > -2").select("q", "v").toArrow()
    held.destroy()
    return out.column("q").to_numpy(), vectors(out.column("v").combine_chunks())


def build(
    candidates: DataFrame, n: int, k: int, *, list_rows: int, max_lists: int, replicas: int, closure: float, target: float,
    sample_rows: int, sample_queries: int,
) -> Index:
    """An index fitted on a sample of the candidates and calibrated against brute force over all of them."""
    import numpy as np

    share = min(1.0, sample_rows / n)
    picked = candidates.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("vec_id", "v")
    drawn = picked.limit(sample_rows + sample_rows // 4).toArrow().sort_by("vec_id")
    sample, ids = vectors(drawn.column("v").combine_chunks()), drawn.column("vec_id").to_numpy()
    index = Index(sample, int(np.clip(n // list_rows, 1, min(max_lists, max(1, len(sample) // 4)))))
    if len(index.centres) > 1 and n > k + 1:
        every = max(1, len(sample) // sample_queries)
        owner, near = true_neighbours(candidates, ids[::every], sample[::every], k)
        index.calibrate(sample[::every], owner, near, target, replicas, closure)
    return index


def nearest(
    rows: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, list_rows: int = 64,
    max_lists: int = 16_384, replicas: int = 2, closure: float = 1.15, target: float = 0.96, sample_rows: int = 65_536,
    sample_queries: int = 512, block_rows: int = 4096,
) -> DataFrame:
    """The k nearest rows of each row for which is_query (an expression of vec_id) holds, itself
    left out: query_id, rank, vec_id, score."""
    import numpy as np

    spark = rows.sparkSession
    clean = usable(rows, id_col, vector_col)
    by_size = clean.groupBy(F.size("v").alias("d")).agg(F.countDistinct("vec_id").alias("n")).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not by_size:
        return spark.createDataFrame([], schema)
    dimension = max(by_size, key=lambda r: (r.n, -r.d))
    clean = clean.where(F.size("v") == dimension.d)
    window = Window.partitionBy("v").orderBy("vec_id")
    candidates = materialize(
        clean.distinct().withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= k + 1).drop("rn"), "candidates"
    )
    n = candidates.count()
    index = build(
        candidates, n, k, list_rows=list_rows, max_lists=max_lists, replicas=replicas, closure=closure, target=target,
        sample_rows=sample_rows, sample_queries=sample_queries,
    )
    held = send(spark, index)
    kind = dict(candidates.dtypes)["v"]
    postings = materialize(candidates.select("vec_id", "v").mapInArrow(assigned(held, replicas, closure), f"list int, vec_id long, v {kind}"), "postings")
    discard(candidates)
    sizes = np.zeros(len(index.centres), np.int64)
    for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.list] = r.n
    shards = Shards.plan(sizes, block_rows)
    shards_held = send(spark, shards)
    asking = clean.where(is_query).distinct()
    reps = materialize(asking.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "queries")

    def ask(queries: DataFrame, every: bool) -> DataFrame:
        out = f"shard int, sub int, vec_id long, v {kind}, lists array<int>"
        probes = materialize(queries.select("vec_id", "v").mapInArrow(probing(held, shards_held, every), out), "probes")
        return search(postings, probes, shards, k + 1, block_rows)

    top = materialize(ask(reps, False), "found")
    whole = F.size("found") >= min(k + 1, n)
    short = reps.join(top.where(whole).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if not short.isEmpty():
        top = top.where(whole).unionByName(ask(short, True))
    mine = asking.withColumnRenamed("vec_id", "query_id").join(reps.withColumnRenamed("vec_id", "rep"), "v").select("query_id", "rep")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        mine.join(top.withColumnRenamed("query_id", "rep"), "rep")
        .select("query_id", F.posexplode(others).alias("rank", "s"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("s.vec_id").alias("vec_id"), (-F.col("s.cost")).alias("score"))
    )


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
