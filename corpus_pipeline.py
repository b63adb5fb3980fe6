"""A training-data pipeline over ``documents``: classify, deduplicate lines and documents,
decontaminate, and pack. Each stage works on all that its predecessor kept.

Columns other than those of ``documents`` are left behind. An empty table runs through. In every stage a
null text is an empty one (lines are kept as text, so it is empty afterwards), a null id is an id of its
own that comes after all others, rows are told apart by id and text, and repeated rows of one id and
text have one fate, but for near duplicates, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import decontaminate, line_dedup, near_copies, packing, quality
from storyloom.llm.common import table
from storyloom.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Statistics, fingerprints and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _join(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs whose (doc_id, hash of the text) is, or is not, among rows (doc_id, text_hash)."""
    keyed = docs.select(*COLUMNS).withColumn("text_hash_", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash_") == F.col("r_hash"))
    return keyed.join(rows, same, how).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without usable labels it rejects none."""
    scored, model = quality.classify(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs.select(*COLUMNS)
    return _join(docs, scored.where(F.col("predicted") == 0), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the largest id that holds them."""
    kept = line_dedup.dedup_lines(docs, carry=["lang", "source"])
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays: texts whose five-word
    shingles have a Jaccard similarity of 0.8 or more, and what these link. Candidates come from op4's fingerprints and
    deletion variants, and, as these reach 2 bits only, what they leave apart from minimum hashes; all are checked exactly."""
    found = materialize(near_copies.near_copies(docs, shingle_words=5, similarity=0.8), "near-duplicates")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    kept = materialize(found.groupBy("component_fp").agg(first.alias("s")).select("s.doc_id", "s.text_hash"), "kept")
    out = _join(docs, kept, "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    # Repeated rows of one id and text are one group, of which one row stays.
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule marks go; the others stay as they are."""
    hits = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    marked = hits.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id", "text_hash")
    return _join(docs, materialize(marked, "contaminated"), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of what is left, with its place in a sequence."""
    return packing.pack(docs).drop("text_hash")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
