"""Entries that keep arriving: deduplication across batches, counts by window, upserts of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyloom.operators import archive
from storyloom.shared import materialize
from storyloom.sources import stored, versions


def first_arrivals(entries: DataFrame, id_col: str = "id", ts_col: str = "published_at", window: str = "24 hours") -> DataFrame:
    """Each id once within the retention window; the state forgets ids as the watermark passes."""
    return entries.withWatermark(ts_col, window).dropDuplicatesWithinWatermark([id_col])


def counts_by_window(entries: DataFrame, key: str = "source_id", ts_col: str = "published_at", length: str = "1 hour", late: str = "24 hours") -> DataFrame:
    """Entries per key and tumbling window, final when the watermark has passed it."""
    return entries.withWatermark(ts_col, late).groupBy(F.window(ts_col, length), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(entries: DataFrame, key: str, ts_col: str = "published_at", gap: str = "18 hours", late: str = "24 hours") -> DataFrame:
    """Runs of entries of one key that are no further apart than the gap."""
    return entries.withWatermark(ts_col, late).groupBy(F.session_window(ts_col, gap), key).agg(F.count(F.lit(1)).alias("n"))


def publish_items(items: DataFrame, table: str, checkpoint: str, as_of: F.Column | None = None) -> StreamingQuery:
    """Merges each batch of items into a table: newer ones replace, aged-out ones go. A batch that is
    run again after a failure changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        now = as_of if as_of is not None else F.current_timestamp()
        stored.recover(spark, table)
        previous = spark.read.parquet(table) if stored.exists(spark, table) else batch.limit(0)
        merged = archive.merge(batch, archive.carry_forward(previous.select(*batch.columns), now))
        stored.replace_table(merged, table)

    return items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_changes(items: DataFrame, table: str, checkpoint: str, as_of: F.Column | None = None, compact: int = 20) -> StreamingQuery:
    """Merges each batch of items into a table of versions (read_published), exactly once.

    A batch reads the items that are still fresh, and writes what it changes: its items that stay, and the ids of those
    they replace. Items that age out are rewritten by nobody: readers leave them out, and so does the next
    whole state. A batch is known to the log by the checkpoint it belongs to, so it is committed once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        change_items(batch, number, table, checkpoint, as_of, compact)

    return items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_items(batch: DataFrame, number: int, table: str, stream: str, as_of: F.Column | None = None, compact: int = 20) -> None:
    spark = batch.sparkSession
    entries = versions.log(spark, table)
    if versions.committed(entries, stream, number):
        return
    now = as_of if as_of is not None else F.current_timestamp()
    before = versions.read(spark, table, "cluster_id", entries)
    fresh = archive.carry_forward(before, now) if before is not None else batch.limit(0)
    fresh = materialize(fresh.select(*batch.columns), "fresh")
    merged = materialize(archive.merge(batch, fresh), "merged")
    kept = merged.join(batch.select("cluster_id").distinct(), "cluster_id", "left_semi")
    gone = (before if before is not None else fresh).select("cluster_id").join(merged, "cluster_id", "left_anti")
    versions.change(spark, table, "cluster_id", entries, stream, number, kept, gone, compact)


def read_published(spark: SparkSession, table: str, as_of: F.Column | None = None) -> DataFrame | None:
    """The items of a table of versions that are still fresh; None before the first batch."""
    rows = versions.read(spark, table, "cluster_id")
    return None if rows is None else archive.carry_forward(rows, as_of if as_of is not None else F.current_timestamp())
