"""Whole runs: from feeds to ranked stories, and on to published items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom import schemas
from storyloom.functions import bounds, json
from storyloom.operators import archive, compliance, ledger, normalize, similarity, stories
from storyloom.shared import materialize


@dataclass
class Ranked:
    articles: DataFrame
    ranked: DataFrame
    shortlist: DataFrame


def rank_feeds(
    feeds: DataFrame, sources: DataFrame, as_of: Column, watchlist: list[stories.Label], *, excludes=normalize.HARD_EXCLUDES,
    noise=stories.NOISE_PHRASES, weights: dict | None = None, previous: DataFrame | None = None, vectors: DataFrame | None = None,
    threshold: float | None = None, limit: int | None = None, stop_words=(), extra_stop_words=(),
) -> Ranked:
    """Feeds (sources.feeds.SCHEMA) to ranked stories; vectors (id, v) are embeddings of articles,
    without which stories are found by TF-IDF, less stop words and accents."""
    found = normalize.normalize(normalize.flatten(feeds, sources), as_of, excludes)
    articles = materialize(similarity.near_duplicates(materialize(found, "articles")), "kept")
    number = articles.withColumn("n_", F.monotonically_increasing_id())
    number = materialize(number, "numbered")
    if vectors is not None:
        rows = number.join(vectors, "id").select(F.col("n_").alias("id"), "v", "published_at")
        pairs = similarity.cosine_pairs(rows, threshold or 0.78, similarity.WINDOW_HOURS)
    else:
        rows = number.select(F.col("n_").alias("id"), F.concat_ws(" ", "title", "title", "snippet").alias("text"))
        weights_of = similarity.tfidf_shared(rows, stop_words=stop_words, extra_stop_words=extra_stop_words, strip_accents=True)
        pairs = similarity.tfidf_links(weights_of, threshold or 0.42, number.select(F.col("n_").alias("id"), "published_at"))
    grouped = stories.stories(stories.assign_stories(number, pairs.select("a", "b"), "n_"))
    tagged = materialize(stories.tag(grouped, watchlist, stories.story_text(F.col("articles"))), "tagged")
    if previous is not None:
        tagged = stories.seen_before(tagged, *archive.signature(previous))
    weights = {x.label: x.weight for x in watchlist if x.weight is not None} if weights is None else weights
    ranked = materialize(stories.score(tagged, as_of, noise, weights), "ranked")
    return Ranked(articles, stories.rank(ranked), materialize(stories.shortlist(ranked, limit), "shortlist"))


def publish_analyses(
    ranked: DataFrame, analyses: DataFrame, as_of: Column, facts: DataFrame, previous: DataFrame, reviews: DataFrame | None = None,
    rules=compliance.RULES, markers=compliance.MARKERS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replies of the analysis (story_id, reply) to (checked, items, ledger): checked has blocked_by
    for every valid reply; items are merged with the previous ones; the ledger has the new facts.

    reviews: (story_id, violations, rewrites) of a reviewer, if there was one.
    """
    schema = T.StructType.fromDDL(schemas.ANALYSIS)
    # Written, so that replies are mended once.
    found = materialize(analyses.select("story_id", json.tolerant_json(F.col("reply")).alias("found")), "replies")
    broken = bounds.first_problem(compliance.ANALYSIS, F.try_parse_json("found"))
    valid = found.where(broken.isNull()).select("story_id", F.from_json("found", schema).alias("a")).select("story_id", "a.*")
    if reviews is None:
        none = F.lit(None)
        valid = valid.withColumns({"violations": none.cast("array<struct<severity:string>>"), "rewrites": none.cast("map<string,string>")})
    else:
        valid = valid.join(reviews.select("story_id", "violations", "rewrites"), "story_id", "left")
    checked = materialize(compliance.enforce(valid, schema, rules, markers), "checked")
    approved = checked.where(F.col("blocked_by").isNull()).select("story_id", F.struct(*schema.fieldNames()).alias("analysis"))
    rows = materialize(ranked.join(approved, "story_id"), "approved")
    new = archive.build_items(rows, F.col("analysis"), as_of)
    new = new.withColumn("analysis", F.struct("analysis.headline", "analysis.hook", "analysis.gist"))
    told = rows.select("story_id", "themes", "entities", F.col("analysis.what_happened").alias("what_happened"), (-F.col("score")).alias("ord"))
    kept = ledger.prune(ledger.record(facts, told, F.date_format(as_of, "yyyy-MM-dd")), as_of)
    return checked, archive.merge(new, archive.carry_forward(previous, as_of)), kept


def run_counts(checked: DataFrame) -> DataFrame:
    """One row: analysed, published and blocked records."""
    return checked.agg(
        F.count(F.lit(1)).alias("analyzed"), F.count_if(F.col("blocked_by").isNull()).alias("published"), F.count_if(F.col("blocked_by").isNotNull()).alias("blocked_by_compliance")
    )


