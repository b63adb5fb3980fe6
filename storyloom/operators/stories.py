"""Articles to stories: clusters, tags, scores and the shortlist."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import dates, text
from storyloom.operators.components import connected_components

#: Weights of source tiers, others 1; of labels without a weight, by group; and of terms.
TIER_WEIGHTS = {"wire": 3.0, "major": 2.0, "sectoral": 1.5, "aggregator": 0.8}
DEFAULT_WEIGHTS = {"themes": 5.0, "entities": 3.0, "sectors": 4.0}
LABEL_WEIGHTS = {
    "Interest Rates": 10.0, "Inflation": 9.0, "Currency": 8.0, "Crude & Energy": 8.0, "Fiscal & Budget": 8.0, "Trade & Tariffs": 7.0,
    "Institutional Flows": 6.0, "Credit & Liquidity": 7.0, "Growth": 7.0, "RBI": 10.0, "SEBI": 8.0, "Government": 6.0, "US Fed": 9.0,
    "Regulators": 5.0, "Banking & Financials": 5.0, "Nifty": 5.0, "Sensex": 5.0, "Global Indices": 3.0,
}
#: Phrases that mark filler, counted in a story's titles.
NOISE_PHRASES = (
    "stock market today", "sensex today", "stock market live", "market wrap", "sensex ends", "nifty ends", "markets end",
    "benchmarks flatline", "horoscope", "astrology", "IPO GMP", "grey market premium", "stocks to watch", "technical view", "F&O ban",
    "gold rate today", "silver rate today", "petrol and diesel price today", "sponsored", "partnered content", "live updates",
    "LIVE blog", "day in pics", "photos",
)
EFOLD_HOURS = 6.0
SHORTLIST = 15
SELECTED = 10


@dataclass
class Label:
    """An entry of the watchlist; groups are themes, institutions, sectors, companies, indices."""

    group: str
    label: str
    aliases: list[str] = field(default_factory=list)
    weight: float | None = None
    ticker: str | None = None


def assign_stories(articles: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """Articles with story, the smallest key of their component over pairs (a, b)."""
    found = connected_components(pairs, "a", "b").select(F.col("id").alias(key), F.col("component").alias("story"))
    return articles.join(found, key, "left").withColumn("story", F.coalesce("story", key))


def stories(assigned: DataFrame) -> DataFrame:
    """A row per story: id from the earliest article, members in order of time, lead, newest_at,
    counts of publishers and feeds, and tier_sum, the tier weights over publishers.

    Two levels: first by story and masthead, where a masthead's tier is that of its newest article, then by story, so
    that no publisher is looked for in a list.
    """
    member = F.struct(
        "published_at", "id", "title", "snippet", "url", "source_id", "source_name", "source_tier",
        text.masthead(F.col("publisher"), F.col("source_id")).alias("masthead"),
    )
    by_masthead = assigned.groupBy("story", text.masthead(F.col("publisher"), F.col("source_id")).alias("masthead")).agg(
        F.collect_list(member).alias("own"), F.max("published_at").alias("newest_at"), F.count(F.lit(1)).alias("n"),
        F.max_by("source_tier", F.struct("published_at", "id")).alias("tier"),
    )
    # Weights as decimals: their sum is the same in any order.
    weight = weight_of(F.col("tier"), 1.0, TIER_WEIGHTS).cast("decimal(12,4)")
    grouped = by_masthead.groupBy("story").agg(
        F.array_sort(F.flatten(F.collect_list("own"))).alias("articles"), F.max("newest_at").alias("newest_at"), F.count("masthead").alias("n_publishers"),
        F.sum("n").alias("n_articles"), F.sum(weight).cast("double").alias("tier_sum"),
    )
    feeds = F.size(F.array_distinct(F.filter(F.transform("articles", lambda a: a["source_id"]), lambda x: x.isNotNull()))).cast("long")
    lead = F.col("articles")[0]
    return grouped.select(
        text.story_id(lead["id"].cast("string")).alias("story_id"), lead["id"].alias("lead_id"), lead["title"].alias("headline"),
        lead["published_at"].alias("published_at"), "newest_at", "n_publishers", feeds.alias("n_feeds"), "n_articles", "tier_sum", "articles",
    )


def with_lead(assigned: DataFrame) -> DataFrame:
    """A row per article still, with the story_id and lead_id of its story, for what needs no list of a story's articles."""
    lead = assigned.groupBy("story").agg(F.min(F.struct("published_at", "id"))["id"].alias("lead_id"))
    return assigned.join(lead, "story").withColumn("story_id", text.story_id(F.col("lead_id").cast("string")))


def story_text(articles: Column) -> Column:
    return F.array_join(F.transform(articles, lambda a: F.concat(a["title"], F.lit(" "), a["snippet"])), " \n ")


def tag(rows: DataFrame, watchlist: list[Label], haystack: Column) -> DataFrame:
    """Adds themes, entities, sectors and tickers, in the watchlist's order: entities are
    institutions, then companies, then indices. One literal alternation per label, no join."""
    rows = rows.withColumn("hay_", haystack)
    return _tagged(rows, watchlist, lambda x: text.any_alias(F.col("hay_"), watchlist[x].aliases)).drop("hay_")


def tag_by_article(articles: DataFrame, watchlist: list[Label], haystack: Column, keys: tuple[str, ...] = ("story_id", "lead_id")) -> DataFrame:
    """The tags of tag() for the stories that keys name, from their articles' haystacks: a row per story, of any number of
    articles, whose texts are never brought together. An alias stands within one article's text."""
    rows = articles.select(*keys, haystack.alias("hay_"))
    hits = [F.when(text.any_alias(F.col("hay_"), x.aliases), F.lit(k)) for k, x in enumerate(watchlist) if x.aliases]
    hits = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")
    found = rows.select(*keys, F.explode_outer(hits).alias("hit")).groupBy(*keys).agg(F.collect_set("hit").alias("hits_"))
    return _tagged(found, watchlist, lambda k: F.array_contains("hits_", k)).drop("hits_")


def _tagged(rows: DataFrame, watchlist: list[Label], hit) -> DataFrame:
    """rows with the labels of the watchlist's entries that hit(place) says are there."""

    def found(*groups: str) -> list[tuple[Label, Column]]:
        return [(x, hit(k)) for g in groups for k, x in enumerate(watchlist) if x.group == g and x.aliases]

    def labels(hits) -> Column:
        values = [F.when(hit, F.lit(x.label)) for x, hit in hits]
        return F.array_distinct(F.array_compact(F.array(*values))) if values else F.array().cast("array<string>")

    entities = found("institutions", "companies", "indices")
    tickers = [F.when(hit, F.lit(x.ticker)) for x, hit in [*found("themes"), *entities, *found("sectors")] if x.ticker]
    return rows.withColumns(
        {
            "themes": labels(found("themes")), "entities": labels(entities), "sectors": labels(found("sectors")),
            "tickers": F.array_distinct(F.array_compact(F.array(*tickers))) if tickers else F.array().cast("array<string>"),
        }
    )


def is_untagged(themes="themes", entities="entities", sectors="sectors", tickers="tickers") -> Column:
    return (F.size(themes) + F.size(entities) + F.size(sectors) + F.size(tickers)) == 0


def weight_of(label: Column, default: float, weights: dict[str, float] = LABEL_WEIGHTS) -> Column:
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.coalesce(F.try_element_at(table, label), F.lit(default))


def weight_sum(labels: Column, default: float, weights: dict[str, float] = LABEL_WEIGHTS) -> Column:
    return F.aggregate(labels, F.lit(0.0), lambda a, x: a + weight_of(x, default, weights))


def seen_before(rows: DataFrame, published_ids: DataFrame, published_urls: DataFrame, own_urls: DataFrame | None = None) -> DataFrame:
    """Adds already_published: by story id, or by any article's URL, in articles or (story_id, url) of own_urls. Two equality
    joins."""
    by_id = published_ids.select(F.col("story_id"), F.lit(True).alias("id_seen")).distinct()
    if own_urls is None:
        own_urls = rows.select("story_id", F.explode(F.transform("articles", lambda a: a["url"])).alias("url"))
    by_url = own_urls.where(F.col("url") != "").join(published_urls.select("url").distinct(), "url", "left_semi").select("story_id").distinct()
    by_url = by_url.withColumn("url_seen", F.lit(True))
    out = rows.join(by_id, "story_id", "left").join(by_url, "story_id", "left")
    return out.withColumn("already_published", F.coalesce("id_seen", "url_seen", F.lit(False))).drop("id_seen", "url_seen")


def score(rows: DataFrame, as_of: Column, noise=NOISE_PHRASES, weights: dict[str, float] = LABEL_WEIGHTS) -> DataFrame:
    """Adds score and its terms (breakdown, each rounded); the score rounds the sum of the terms.

    Recency falls to 1/e in EFOLD_HOURS. Untagged is a term only where there is no tag.
    """
    titles = F.array_join(F.transform("articles", lambda a: a["title"]), " ")
    terms = {
        "corroboration": 4.0 * F.log1p("tier_sum"),
        "macro": weight_sum(F.col("themes"), DEFAULT_WEIGHTS["themes"], weights),
        "entities": weight_sum(F.col("entities"), DEFAULT_WEIGHTS["entities"], weights) * 0.6,
        "sectors": weight_sum(F.col("sectors"), DEFAULT_WEIGHTS["sectors"], weights) * 0.4,
        "recency": 12.0 * F.exp(-F.greatest(F.lit(0.0), dates.age_hours(F.col("newest_at"), as_of)) / EFOLD_HOURS),
        "novelty": F.when(F.col("already_published"), -25.0).otherwise(5.0) if "already_published" in rows.columns else F.lit(5.0),
        "noise": -6.0 * text.count_phrases(titles, noise),
        "untagged": F.when(is_untagged(), F.lit(-8.0)),
    }
    rows = rows.withColumn("terms_", F.struct(*(v.cast("double").alias(k) for k, v in terms.items())))
    total = sum((F.coalesce(F.col("terms_")[k], F.lit(0.0)) for k in terms), F.lit(0.0))
    breakdown = F.struct(*(F.round(F.col("terms_")[k], 2).alias(k) for k in terms))
    return rows.withColumns({"score": F.round(total, 2), "breakdown": breakdown}).drop("terms_")


def rank(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.desc("newest_at"), "story_id")


def shortlist(rows: DataFrame, limit: int | None = None, candidates: int = SHORTLIST) -> DataFrame:
    """The best stories with a positive score, with rn and whether each is selected."""
    order = [F.desc("score"), F.desc("newest_at"), F.asc("story_id")]
    top = rows.where(F.col("score") > 0).orderBy(*order).limit(candidates)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order))).withColumn("selected", F.col("rn") <= (limit or SELECTED))


def upper_median(rows: DataFrame, column: str = "score") -> DataFrame:
    """The value at n // 2 of the falling order; 0 for no rows. Equal values are counted first; one task adds up the
    counts of distinct values, which are few for scores of two decimals."""
    n = rows.agg(F.count(column).alias("n"))
    by_value = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    run = by_value.withColumn("upto", F.sum("c").over(Window.orderBy(F.desc(column))))
    found = run.crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.max(column).alias("m"))
    return found.select(F.coalesce("m", F.lit(0.0)).alias("median"))


def blend_triage(rows: DataFrame, triage: DataFrame) -> DataFrame:
    """Reordered by triage rows (story_id, triage_score, reason, explainer_worthy); others keep their score."""
    joined = rows.join(triage, "story_id", "left")
    fair = F.col("score") - F.when(F.col("explainer_worthy") == F.lit(False), 20.0).otherwise(0.0)
    blended = F.round(0.5 * fair + 0.5 * (F.col("triage_score") * 0.8), 2)
    return joined.withColumn("score", F.when(F.col("triage_score").isNotNull(), blended).otherwise(fair))


def triage_payload(rows: DataFrame, as_of: Column) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform("articles", lambda a: a["source_name"])))
    age = F.round((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 60_000_000).cast("long")
    return rows.select(
        "story_id", "headline", F.col("n_publishers").alias("source_count"), names.alias("sources"),
        F.concat("themes", "entities", "sectors").alias("tags"), age.alias("age_minutes"),
    )


def analysis_payload(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(story_id, payload JSON) of articles, tags and earlier facts (story_id, facts array)."""
    article = lambda a: F.struct(
        a["source_name"].alias("source"), a["title"].alias("headline"), a["snippet"].alias("snippet"), a["published_at"].alias("published_at"), a["url"].alias("url")
    )
    tags = F.struct("entities", "tickers", "sectors", F.col("themes").alias("macro_themes"))
    joined = rows.join(facts, "story_id", "left")
    return joined.select(
        "story_id",
        F.to_json(F.struct(F.col("story_id").alias("cluster_id"), F.transform("articles", article).alias("articles"), tags.alias("watchlist_tags"), F.col("facts").alias("prior_related_events"))).alias("payload"),
    )


def dump(ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """Stories as the inspection file has them, with the selected ones marked."""
    chosen = selected.select("story_id", F.lit(True).alias("sel")).distinct()
    titles = F.transform("articles", lambda a: F.struct(a["masthead"].alias("pub"), a["source_id"].alias("src"), a["title"].alias("title")))
    return ranked.join(chosen, "story_id", "left").select(
        F.col("story_id").alias("id"), F.coalesce("sel", F.lit(False)).alias("selected"), "score", "breakdown", "n_articles", "n_publishers", "n_feeds",
        F.struct("entities", "tickers", "sectors", F.col("themes").alias("macro_themes")).alias("tags"), titles.alias("titles"),
    )


def summary(ranked: DataFrame, selected: DataFrame, started: Column) -> DataFrame:
    whole = ranked.agg(
        F.coalesce(F.sum("n_articles"), F.lit(0)).alias("articles"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n_articles") > 1).alias("multi_article_clusters")
    )
    return whole.crossJoin(F.broadcast(selected.agg(F.count(F.lit(1)).alias("selected")))).select(started.alias("started"), "*")
