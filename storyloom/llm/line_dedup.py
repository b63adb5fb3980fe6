"""Line deduplication over a corpus, by DataFrame functions only.

Plan: explode the normalised lines, hash them (128 bits), count distinct documents per hash
with partial aggregation, drop the lines over the threshold, and reassemble each text by
position. Only hashes and positions are shuffled for counting; each text moves at most once,
for the join with its own dropped positions.

Defined results: a null or empty text is one empty line. Rows that share a doc_id are one
document for counting, and each is cleaned by itself. Lines of rows with a null doc_id don't
count towards the threshold and lose their repeated lines, since a null is never the largest
doc_id. Only the named columns are read, so extra columns of any name do no harm. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import SPACES, ascii_lower, table
from storyloom.shared import materialize


def line_key(line):
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    carry: list[str] = (),
) -> DataFrame:
    """Drops each line whose key has min_chars code points or more and is found in min_docs
    documents or more, except in the largest id that holds it.

    Returns id_col, text_hash (tells rows of one id apart), text (what stays), n_lines, n_dropped,
    and the columns of docs named in carry as they are.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"),
        F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
    )
    trimmed = F.btrim("line", F.lit(SPACES))
    occurrences = materialize(
        base.select("id", "text_hash", F.posexplode("lines").alias("pos", "line"))
        .where(F.length(trimmed) >= min_chars)
        .withColumn("key", ascii_lower(trimmed))
        .select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")),
        "lines",
    )
    # Written, so that the join below has plain shuffles on both sides and a hot line's occurrences
    # can be split between tasks.
    repeated = materialize(
        occurrences.groupBy("h1", "h2")
        .agg(F.countDistinct("id").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper"),
        "repeated",
    )
    dropped = (
        occurrences.join(repeated, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "text_hash")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.col("id").alias("d_id"), F.col("text_hash").alias("d_hash"), "gone")
    )
    joined = base.join(
        dropped, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")), "left"
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return joined.select(
        F.col("id").alias(id_col),
        "text_hash",
        F.when(F.col("gone").isNull(), F.array_join("lines", "\n"))
        .otherwise(F.array_join(F.transform(stay, lambda p: F.col("lines")[p]), "\n"))
        .alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        *(F.col("carried").getField(c).alias(c) for c in carry),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z FROM
         (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) s,
       LATERAL (SELECT z[1] AS pos, z[2] AS line) u
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
