"""How the sources of each language differ in the terms that they use, exactly, by DuckDB over shards.

A language keeps the terms that at least ``min_docs`` of its documents hold (V of them). A group, which is a
language and source, or a whole language, gives each kept term the weight
p = 1 + floor(SCALE * (count + 1) / (N + V)), where N sums its counts. The divergence of two weights is
floor((p - q)**2 / q). Part ``pair`` sums it over all kept terms for every two sources of a language, part
``term`` lists the terms that a source uses more than its language does.

1. Every task splits its texts into terms and counts them by SQL, a slice of texts at a time: rows (lang,
   source, term, n, docs).
2. Rows are dealt to shards by the hash of (lang, term), about ``shard_rows`` each; SQL per shard sums them
   up and keeps terms. A term has at most a row for each task and source, so a hot source or term is no more
   than that.
3. Spark sums up N of each group and V of each language, and joins them to the kept counts.
4. The shards are dealt again. SQL per shard compares the sources of each term with each other. It doesn't
   touch a source that lacks the term: a source's weight for such terms is one number, z. With x and y for the
   weights of two sources, the sum of f(x, y) over all kept terms is, with as many summands as there are counts,

       V * f(zx, zy)
       + sum over the terms of the first: f(x, zy) - f(zx, zy)
       + sum over the terms of the second: f(zx, y) - f(zx, zy)
       + sum over the terms of both: f(x, y) - f(x, zy) - f(zx, y) + f(zx, zy)

   The last sum is a shard's partial pair sum. The two in the middle need only how often a source has a weight,
   which a shard counts. Each shard also ranks its terms, and hands over the first ``top`` of each group.
5. Spark adds up partial sums and weights' numbers, and ranks.

Numbers are whole throughout; sums are held in 38 decimal digits and returned as long.

Defined results: null text, lang and source are read as empty. A row is a document, repeated or not. A group
without terms has its pairs with all other sources (0 if V is 0), and no terms. A language with one source has
no pairs. Equal values are ranked by the item's UTF-8 bytes. An empty table gives no rows. Only the named
columns are read; they may be of any type that can be read as text. DuckDB never writes to disk: what it holds
is a slice, a task's counts up to ``held_rows``, or a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.shared import materialize

SCALE = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[a-z\x{80}-\x{10FFFF}]+"


def connect(memory: str = "1GB"):
    """A database in memory, on one thread as Spark runs a worker per core, which may not write to disk."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": "", "preserve_insertion_order": False})


def arrow(found, batch_rows: int = 65_536):
    """Batches of a result, as it comes."""
    reader = found.to_arrow_reader(batch_rows)
    for batch in reader:
        if batch.num_rows:
            yield batch


COUNT = f"""
INSERT INTO counts
SELECT lang, source, term, CAST(sum(n) AS BIGINT), count(*) FROM (
  SELECT doc, lang, source, term, count(*) AS n FROM (
    SELECT doc, lang, source, unnest(regexp_extract_all(CASE WHEN strlen(text) = length(text) THEN lower(text)
           ELSE translate(text, '{UPPER}', '{LOWER}') END, '{TERM}')) AS term FROM texts)
  GROUP BY ALL)
GROUP BY ALL
"""

SUMMED = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY ALL"


def slices(batch, most_bytes: int):
    """The batch with row numbers, in slices of about most_bytes of text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    numbered = pa.table([*batch.columns, pa.array(np.arange(batch.num_rows))], [*batch.schema.names, "doc"])
    at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // most_bytes
    for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(at)) + 1):
        if len(part):
            yield numbered.slice(part[0], len(part))


def counter(held_rows: int, slice_bytes: int):
    def run(batches):
        con = connect()
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        size = 0
        for batch in batches:
            for part in slices(batch, slice_bytes):
                con.register("texts", part)
                con.execute(COUNT)
                con.unregister("texts")
                ((size,),) = con.execute("SELECT count(*) FROM counts").fetchall()
                if size > held_rows:
                    yield from arrow(con.sql(SUMMED))
                    con.execute("TRUNCATE counts")
                    size = 0
        if size:
            yield from arrow(con.sql(SUMMED))

    return run


KEPT = """
SELECT lang, source, term, n, CAST(sum(n) OVER t AS BIGINT) AS lang_n, row_number() OVER t = 1 AS first
FROM (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM rows GROUP BY ALL)
WINDOW t AS (PARTITION BY lang, term)
QUALIFY sum(docs) OVER t >= {min_docs}
"""


def keeper(min_docs: int):
    def run(batches):
        import pyarrow as pa

        batches = list(batches)
        if batches:
            con = connect()
            con.register("rows", pa.Table.from_batches(batches))
            yield from arrow(con.sql(KEPT.format(min_docs=min_docs)))

    return run


WEIGHTS = f"""
CREATE TEMP TABLE w AS SELECT *,
  CAST(1 + ({SCALE}::HUGEINT * (n + 1)) // (total + v) AS BIGINT) AS p, CAST(1 + {SCALE}::HUGEINT // (total + v) AS BIGINT) AS z,
  CAST(1 + ({SCALE}::HUGEINT * (lang_n + 1)) // (lang_total + v) AS BIGINT) AS q
FROM rows
"""

PAIRS = """
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CAST(NULL AS BIGINT) AS p,
  CAST(sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.z) * (a.p - b.z) // b.z - (a.z - b.p) * (a.z - b.p) // b.p
           + (a.z - b.z) * (a.z - b.z) // b.z) AS DECIMAL(38, 0)) AS value
FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
GROUP BY ALL
"""

NUMBERS = """
SELECT 'number' AS part, lang, source, '' AS item, p, CAST(count(*) AS DECIMAL(38, 0)) AS value FROM w GROUP BY ALL
"""

TERMS = """
SELECT 'term' AS part, lang, source, term AS item, CAST(NULL AS BIGINT) AS p, CAST((p - q) * (p - q) // q AS DECIMAL(38, 0)) AS value
FROM w WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) <= {top}
"""


def comparer(top: int):
    def run(batches):
        import pyarrow as pa

        batches = list(batches)
        if batches:
            con = connect()
            con.register("rows", pa.Table.from_batches(batches))
            con.execute(WEIGHTS)
            con.unregister("rows")
            batches.clear()
            for sql in (PAIRS, NUMBERS, TERMS.format(top=top)):
                yield from arrow(con.sql(sql))

    return run


def _deal(rows: DataFrame, number: int, shard_rows: int) -> DataFrame:
    return rows.repartition(max(1, -(-number // shard_rows)), "lang", "term")


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200,
    shard_rows: int = 250_000, held_rows: int = 1_000_000, slice_bytes: int = 4 << 20,
) -> DataFrame:
    """lang, source, part (pair or term), item (another source, or a term), value, rank (from 1 in each group and
    part; pairs: all, terms: up to top)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = materialize(
        read.mapInArrow(counter(held_rows, slice_bytes), "lang string, source string, term string, n long, docs long"), "counts"
    )
    kept = _deal(counts, counts.count(), shard_rows).mapInArrow(
        keeper(min_docs), "lang string, source string, term string, n long, lang_n long, first boolean"
    )
    kept = materialize(kept, "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"), F.count_if("first").alias("v"))
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "terms", "v"])
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("v"))
    groups = materialize(groups.drop("v").join(langs, "lang"), "totals")

    rows = kept.drop("first").join(groups.drop("terms"), ["lang", "source"])
    schema = "part string, lang string, source string, item string, p long, value decimal(38,0)"
    shards = materialize(_deal(rows, kept.count(), shard_rows).mapInArrow(comparer(top), schema), "shards")

    terms = shards.where("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"))
    pairs = _pairs(groups, shards)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best)
    return (
        pairs.withColumn("rank", rank)
        .unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
        .select("lang", "source", "part", "item", "value", "rank")
    )


def _pairs(groups: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, source, part, item, value of every two sources of a language."""
    f = lambda x, y: f"cast(({x} - {y}) * ({x} - {y}) div {y} as decimal(38,0))"
    z = F.expr(f"case when total + v > 0 then 1 + {SCALE} div (total + v) else 1 end")
    each = groups.select("lang", "source", "v", "terms", z.alias("z"))
    other = each.select("lang", F.col("source").alias("item"), F.col("z").alias("zy"), F.col("terms").alias("item_terms"))
    every = each.withColumnRenamed("z", "zx").join(other, "lang").where("source <> item")
    base = every.select("lang", "source", "item", F.expr(f"(v - terms - item_terms) * {f('zx', 'zy')}").cast("decimal(38,0)").alias("value"))
    # How often a source has each weight: as many rows as it has different counts.
    numbers = shards.where("part = 'number'").groupBy("lang", "source", "p").agg(F.sum("value").cast("decimal(38,0)").alias("n"))
    numbers = numbers.join(each.select("lang", "source", "z"), ["lang", "source"])
    ends = each.select("lang", F.col("source").alias("other"), F.col("z").alias("zo"))
    met = numbers.join(ends, "lang").where("source <> other")
    first = met.groupBy("lang", "source", F.col("other").alias("item")).agg(F.expr(f"cast(sum(n * {f('p', 'zo')}) as decimal(38,0))").alias("value"))
    second = met.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(
        F.expr(f"cast(sum(n * {f('zo', 'p')}) as decimal(38,0))").alias("value")
    )
    both = shards.where("part = 'pair'").select("lang", "source", "item", "value")
    summed = base.unionByName(first).unionByName(second).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), t AS (SELECT doc, lang, source, unnest(w) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), k AS (SELECT lang, term FROM (SELECT DISTINCT lang, doc, term FROM t) GROUP BY ALL HAVING count(*) >= 3
), groups AS (SELECT DISTINCT lang, source FROM d
), g AS (
  SELECT groups.lang, groups.source, k.term, coalesce(c.n, 0) AS n FROM groups JOIN k ON groups.lang = k.lang
  LEFT JOIN c ON c.lang = groups.lang AND c.source = groups.source AND c.term = k.term
), l AS (SELECT lang, term, sum(n) AS n FROM g GROUP BY ALL
), p AS (
  SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS BIGINT) AS p FROM g
  WINDOW s AS (PARTITION BY lang, source)
), q AS (
  SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS BIGINT) AS q FROM l
  WINDOW s AS (PARTITION BY lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM every LEFT JOIN pair USING (lang, source, item)
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term
  WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found
QUALIFY part = 'pair' OR rank <= 200
"""
