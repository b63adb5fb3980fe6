"""Ranked lexical search, score at a time over postings in the order of their impact.

1. ``build``: every task splits its texts into terms and writes shards of at most ``shard_docs`` documents or
   about ``shard_terms`` terms: a row with the documents' ids and lengths, the shard's terms, and for each term its
   documents and how often they hold it. Nothing is shuffled, and no term's postings meet in one place.
2. Numbers of documents and terms are summed up over shards, and the documents of the queries' terms by one
   aggregation over (term, number) rows.
3. ``search``: the index's files, of one shard each, are dealt to tasks, which read one after the other. Queries are streamed in blocks of at most ``block_terms`` (query, term) rows; a block is sent to all
   tasks, one block at a time. A task goes through its shards. It turns a shard's postings of the block's terms into
   impacts, which are whole numbers, and groups them by exact impact. For each query the groups of its
   terms are processed from the largest impact down, into an accumulator per document. When, of no term,
   what isn't processed yet can lift a document that isn't a candidate to the k-th score found so far, in
   this shard or in the task's shards before it, processing stops; the candidates' scores are then
   completed from the shard's document order. Every bound takes equal scores for possible, so results are exact.
4. A task returns each query's first k of its shards, and Spark ranks these.

A score is the sum over the query's distinct terms of w * ((UNIT * tf) div (1000 * tf + 20 * m)), where
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 50 + (50 * n * N) div L, for N documents with terms, L terms
and n terms in the document.

Defined results: a null text has no terms; documents without terms aren't found and don't count in N. Queries
without terms, or of terms that no document holds, find nothing. Repeated rows are documents of their own, so
are repeated queries, each with ranks of its own. Equal scores are ranked by ascending id, a null id first, and
rows of one id in any order, as their results are equal. Ids may be of any type that can be sorted. A very long text
may be a shard by itself. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import received, send, table, utf8
from storyloom.llm.decontaminate import FOLD
from storyloom.llm.warc import file_system
from storyloom.shared import materialize

UNIT = 1_000_000_000

SHARD = "ids array<{id}>, lengths array<int>, terms array<string>, dfs array<int>, docs binary, tfs binary"


def builder(shard_docs: int, shard_terms: int):
    """Rows of shards from (id, text)."""

    def shard(ids, lengths, flat):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = pa.concat_arrays(flat).dictionary_encode()
        # Terms in an order of their own, so that a retried task writes the same shard.
        by_term = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(by_term), np.int64)
        place[by_term] = np.arange(len(by_term))
        n = len(lengths)
        pairs, tfs = np.unique(place[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), lengths), return_counts=True)
        terms, docs = np.divmod(pairs, n)
        dfs = np.bincount(terms, minlength=len(by_term)).astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [lists(pa.concat_arrays(ids)), lists(pa.array(lengths, pa.int32())), lists(coded.dictionary.take(pa.array(by_term)).cast(pa.string())),
                   lists(pa.array(dfs)), pa.array([docs.astype("<i4").tobytes()]), pa.array([tfs.astype("<i4").tobytes()])]
        return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "terms", "dfs", "docs", "tfs"])

    def run(batches):
        import pyarrow as pa

        ids, lengths, flat, size = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                words = utf8(text.as_py()).translate(FOLD).split()
                if not words:
                    continue
                if lengths and (len(lengths) >= shard_docs or size + len(words) > shard_terms):
                    yield shard(ids, lengths, flat)
                    ids, lengths, flat, size = [], [], [], 0
                ids.append(pa.array([i.as_py()], batch.schema.field("id").type))
                lengths.append(len(words))
                flat.append(pa.array(words, pa.binary()))
                size += len(words)
        if lengths:
            yield shard(ids, lengths, flat)

    return run


def build(docs: DataFrame, id_col: str, text_col: str, shard_docs: int, shard_terms: int) -> DataFrame:
    """The index, a row per shard; a written table, a shard a file, so that a task's memory doesn't grow with its shards."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(builder(shard_docs, shard_terms), SHARD.format(id=dict(source.dtypes)["id"]))
    return materialize(found, "shards", file_rows=1)


def term_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item, term) of each distinct term of each row; query tells rows apart. A written table."""
    source = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [sorted(set(utf8(t.as_py()).translate(FOLD).split())) for t in batch.column("text")]
            at = pa.array(np.repeat(np.arange(len(found)), [len(w) for w in found]), pa.int64())
            flat = pa.array([x for w in found for x in w], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("query").take(at), batch.column("item").take(at), flat], ["query", "item", "term"])

    # Numbered in a written table: a number must not change if a task is repeated.
    numbered = materialize(source.withColumn("query", F.monotonically_increasing_id()), "items")
    return materialize(numbered.mapInArrow(run, f"query long, item {dict(source.dtypes)['item']}, term string"), "terms")


class Block:
    """Some queries: their numbers, and the numbers of the distinct terms of each, with the terms' weights."""

    def __init__(self, rows: list[tuple[int, str, int]]) -> None:
        import numpy as np

        self.terms = sorted({r[1] for r in rows})
        number = {t: k for k, t in enumerate(self.terms)}
        self.weights = np.zeros(len(self.terms), np.int64)
        held: dict[int, list[int]] = {}
        for query, term, weight in rows:
            self.weights[number[term]] = weight
            held.setdefault(query, []).append(number[term])
        self.queries = {q: np.array(sorted(t), np.int64) for q, t in held.items()}


def blocks(weighted: DataFrame, block_terms: int):
    """Blocks of whole queries with about block_terms rows of (query, term, w) each, in the order of queries."""
    rows, last = [], None
    for r in weighted.repartitionByRange("query").sortWithinPartitions("query").toLocalIterator():
        if len(rows) >= block_terms and r.query != last:
            yield Block(rows)
            rows = []
        rows.append((r.query, r.term, r.w))
        last = r.query
    if rows:
        yield Block(rows)


def spans(starts, sizes):
    """The numbers start, start + 1, ... of each range, one range after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Impacts:
    """A shard's postings of a block's terms: by term and falling impact, grouped, and by document."""

    def __init__(self, row, block: Block, n_docs: int, n_terms: int) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.n = len(row["lengths"])
        known = pc.index_in(row["terms"], value_set=pa.array(block.terms, pa.string())).fill_null(-1).to_numpy()
        dfs = row["dfs"].to_numpy()
        own = np.flatnonzero(known >= 0)
        at = spans((np.cumsum(dfs, dtype=np.int64) - dfs)[own], dfs[own])
        docs = np.frombuffer(row["docs"], "<i4")[at].astype(np.int64)
        tfs = np.frombuffer(row["tfs"], "<i4")[at].astype(np.int64)
        terms = np.repeat(known[own].astype(np.int64), dfs[own])
        m = 50 + (50 * row["lengths"].to_numpy().astype(np.int64) * n_docs) // n_terms
        impacts = block.weights[terms] * ((UNIT * tfs) // (1000 * tfs + 20 * m[docs]))
        some = impacts > 0
        docs, terms, impacts = docs[some], terms[some], impacts[some]
        order = np.lexsort((-impacts, terms))
        self.docs, terms, impacts = docs[order], terms[order], impacts[order]
        new = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(impacts) != 0)]) if len(terms) else np.empty(0, np.int64)
        self.start, self.impact, group_term = new, impacts[new], terms[new]
        self.size = np.diff(np.r_[new, len(terms)])
        # A term's groups are [first, last).
        self.first = np.searchsorted(group_term, np.arange(len(block.terms)))
        self.last = np.searchsorted(group_term, np.arange(len(block.terms)), side="right")
        back = np.argsort(self.docs, kind="stable")
        self.by_doc_term, self.by_doc_impact = terms[back], impacts[back]
        self.doc_start = np.searchsorted(self.docs[back], np.arange(self.n + 1))
        self.asked = np.zeros(len(block.terms), bool)

    def complete(self, docs, terms):
        """The documents' whole scores for these terms."""
        import numpy as np

        self.asked[terms] = True
        sizes = self.doc_start[docs + 1] - self.doc_start[docs]
        at = spans(self.doc_start[docs], sizes)
        hit = self.asked[self.by_doc_term[at]]
        self.asked[terms] = False
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), sizes)[hit], self.by_doc_impact[at][hit])
        return out

    def best(self, terms, k: int, floor: int, step: int = 4096):
        """(documents, scores, postings processed): all documents with one of the k largest scores above 0 that are
        at least floor, and maybe some others."""
        import numpy as np

        terms = terms[self.first[terms] < self.last[terms]]
        sizes = self.last[terms] - self.first[terms]
        groups = spans(self.first[terms], sizes)
        owner = np.repeat(np.arange(len(terms)), sizes)
        order = np.argsort(-self.impact[groups], kind="stable")  # a term's groups stay in their order
        groups, owner = groups[order], owner[order]
        ends = np.cumsum(self.size[groups])
        total = int(ends[-1]) if len(ends) else 0
        scores, following = np.zeros(self.n, np.int64), self.first[terms].copy()
        done = at = 0
        while at < len(groups):
            to = max(int(np.searchsorted(ends, done + max(step, done), side="right")), at + 1)
            own = groups[at:to]
            hits = spans(self.start[own], self.size[own])
            np.add.at(scores, self.docs[hits], np.repeat(self.impact[own], self.size[own]))
            following += np.bincount(owner[at:to], minlength=len(terms))
            at, done = to, int(ends[to - 1])
            left = following < self.last[terms]
            rest = int(self.impact[following[left]].sum())  # what a document may still gain
            enough = max(floor, int(np.partition(scores, self.n - k)[self.n - k]) if self.n >= k else 0, 1)
            if rest < enough and at < len(groups):
                candidates = np.flatnonzero(scores + rest >= enough)
                # They are exact already, or cheaper to complete than the rest is to process.
                if (self.doc_start[candidates + 1] - self.doc_start[candidates]).sum() <= total - done:
                    return candidates, self.complete(candidates, terms), done
        enough = max(floor, int(np.partition(scores, self.n - k)[self.n - k]) if self.n >= k else 0, 1)
        found = np.flatnonzero(scores >= enough)
        return found, scores[found], done


def shards_of(uri: str):
    """The shards of a file of the index, one by one."""
    import pyarrow.parquet as pq

    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        yield from pq.ParquetFile(f).iter_batches(batch_size=1)


def searcher(held, k: int, n_docs: int, n_terms: int):
    """Rows (query, id, score) from rows (file): each query's first k in the task's shards, of which one is held at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        block, best, kind = received(held), {}, None
        for uri in (u for batch in batches for u in batch.column("file").to_pylist()):
            for batch in shards_of(uri):
                row = {c: batch.column(c)[0].values for c in ("ids", "lengths", "terms", "dfs")}
                row |= {c: batch.column(c)[0].as_py() for c in ("docs", "tfs")}
                kind = row["ids"].type
                shard = Impacts(row, block, n_docs, n_terms)
                for query, terms in block.queries.items():
                    scores, ids = best.get(query, (np.empty(0, np.int64), pa.array([], kind)))
                    floor = int(scores[k - 1]) if len(scores) >= k else 1
                    docs, found, _ = shard.best(terms, k, floor)
                    some = found >= floor
                    if not some.any():
                        continue
                    scores, ids = np.r_[scores, found[some]], pa.concat_arrays([ids, row["ids"].take(pa.array(docs[some]))])
                    order = pc.sort_indices(
                        pa.table([pa.array(scores), ids], ["score", "id"]),
                        sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_start",
                    )[:k]
                    best[query] = scores[order.to_numpy()], ids.take(order)
        if best:
            sizes = [len(s) for s, _ in best.values()]
            queries = np.repeat(np.array(list(best), np.int64), sizes)
            ids = pa.concat_arrays([i for _, i in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(queries), ids, pa.array(np.concatenate([s for s, _ in best.values()]))], ["query", "id", "score"])

    return run


def search(
    docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", shard_docs: int = 65_536, shard_terms: int = 2_000_000, block_terms: int = 200_000,
) -> DataFrame:
    """item_col, rank (from 1), id_col and score of the k best documents for each item."""
    shards = build(docs, id_col, text_col, shard_docs, shard_terms)
    terms = term_rows(items, item_col, item_text_col)
    sums = shards.agg(F.sum(F.size("lengths")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    n_docs, n_terms = sums.n or 0, sums.l or 0
    schema = f"query long, id {dict(docs.dtypes)[id_col]}, score long"
    # The terms of queries only; a term is a row for each shard that holds it.
    held = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = materialize(terms.join(df, "term").select("query", "term", weight.alias("w")).where("w > 0"), "weights")
    files = shards.select(F.input_file_name().alias("file")).distinct()
    files = materialize(files, "files").repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
    found = []
    for block in blocks(weighted, block_terms):
        sent = send(docs.sparkSession, block)
        # Written before the next block is made, so that one block is held at a time.
        found.append(materialize(files.mapInArrow(searcher(sent, k, n_docs, n_terms), schema), "found"))
        sent.destroy()
    every = docs.sparkSession.createDataFrame([], schema)
    for rows in found:
        every = every.unionByName(rows)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = terms.select("query", "item").distinct()
    return ranked.join(names, "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, row_number() OVER () AS query, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark
), sums AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0
), asked AS (SELECT item_id, query, unnest(w) AS term FROM b
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term, nn
), m AS (SELECT r, doc_id, 50 + (50 * len(w) * nn) // ll AS m FROM d, sums WHERE len(w) > 0
), scores AS (
  SELECT a.item_id, a.query, m.r, m.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked a JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 50
"""
