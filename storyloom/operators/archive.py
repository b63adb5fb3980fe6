"""Published items across runs: loading, signatures, merging, and what readers get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators.claims import greedy_losers
from storyloom.operators.normalize import RETENTION_HOURS, within_retention

VERSION = "1.0"


def build_items(stories: DataFrame, analysis: Column, as_of: Column) -> DataFrame:
    source = lambda a: F.struct(
        a["source_name"].alias("name"), a["title"].alias("headline"), a["url"].alias("url"), a["published_at"].cast("string").alias("published_at")
    )
    tags = F.struct("entities", "tickers", "sectors", F.col("themes").alias("macro_themes"))
    return stories.select(
        F.col("story_id").alias("cluster_id"), analysis.alias("analysis"), tags.alias("tags"), F.transform("articles", source).alias("sources"),
        "published_at", as_of.alias("updated_at"), analysis["confidence"].alias("confidence"), F.lit("free").alias("tier"),
    )


def carry_forward(previous: DataFrame, as_of: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Valid items that haven't aged out; one exactly as old as the window stays."""
    return previous.where(F.col("cluster_id").isNotNull() & F.col("published_at").isNotNull() & within_retention(F.col("published_at"), as_of, hours))


def signature(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(story_id) and (url) that are published; blank URLs are none."""
    urls = items.select(F.explode(F.transform("sources", lambda s: s["url"])).alias("url")).where(F.col("url") != "")
    return items.select(F.col("cluster_id").alias("story_id")).distinct(), urls.distinct()


def upsert(previous: DataFrame, new: DataFrame, key: str = "cluster_id") -> DataFrame:
    return previous.join(new.select(key), key, "left_anti").unionByName(new)


def merge(new: DataFrame, previous: DataFrame, fold_owners: int = 100_000) -> DataFrame:
    """Items of both runs, newer ones in the place of older ones of the same id or with a shared URL.

    Newest update first, an item goes if it shares a URL with one that is kept; what goes claims
    nothing. Decided in parallel rounds, see ``claims``; items without URLs always stay. An item without a time of
    its update comes first.
    """
    both = upsert(previous, new)
    urls = both.select("cluster_id", "updated_at", F.explode(F.transform("sources", lambda s: s["url"])).alias("key")).where(F.col("key") != "")
    micros = F.unix_micros(F.col("updated_at").cast("timestamp"))
    gone = greedy_losers(urls.withColumnRenamed("cluster_id", "owner"), [(-micros).alias("age")], fold_owners=fold_owners)
    return both.join(gone.withColumnRenamed("owner", "cluster_id"), "cluster_id", "left_anti").orderBy(F.desc("published_at"), "cluster_id")


def feed_items(items: DataFrame) -> DataFrame:
    """The compact rows of the feed's index."""
    path = lambda a, z: F.concat(F.lit(a), "cluster_id", F.lit(z))
    return items.select(
        "cluster_id", F.col("analysis.headline").alias("headline"), F.col("analysis.hook").alias("hook"), F.col("analysis.gist").alias("gist"),
        "confidence", "tier", "published_at", path("story/", ".html").alias("url"), path("api/v1/clusters/", ".json").alias("api"),
    )


def feed_index(items: DataFrame, as_of: Column, disclaimer: str, hours: int = RETENTION_HOURS) -> DataFrame:
    """One row: the envelope with its items, newest first. For a site's front page, not for a corpus."""
    row = F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("k"), F.struct("*").alias("item"))
    packed = feed_items(items).select(row.alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return packed.select(
        F.lit(VERSION).alias("version"), as_of.cast("string").alias("generated_at"), F.lit(hours).alias("retention_hours"), F.lit(disclaimer).alias("disclaimer"),
        F.size("r").alias("count"), F.transform("r", lambda x: x["item"]).alias("items"),
    )


def cards(items: DataFrame, as_of: Column) -> DataFrame:
    """What a page shows of each item: age in words, first sectors and themes, number of sources."""
    n = F.size("sources")
    return items.select(
        "cluster_id", text.human_time(F.col("published_at"), as_of).alias("published_human"), F.slice("tags.sectors", 1, 4).alias("sectors"),
        F.slice("tags.macro_themes", 1, 3).alias("themes"), F.concat(n.cast("string"), F.lit(" source"), F.when(n != 1, "s").otherwise("")).alias("source_label"),
        F.array_join("analysis.gist", " ").alias("description"),
    )


def retention_audit(items: DataFrame, as_of: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """One row: items, those past the window, and whether there are none."""
    late = F.count_if(~within_retention(F.col("published_at"), as_of, hours))
    return items.agg(F.count(F.lit(1)).alias("n_items"), late.alias("n_late")).withColumn("ok", F.col("n_late") == 0)
