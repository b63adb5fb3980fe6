"""The articles view over the tables ``documents`` and ``events``, and the stages that follow it.

A document is an article, published when the event of the same number happened; its title is its
first twelve words. Every thousand documents belong to eight publishers, and sources to four tiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import normalize, similarity, stories
from storyloom.operators.stories import Label
from storyloom.shared import materialize, spread

TIERS = ("wire", "major", "sectoral", "aggregator")

#: A watchlist of words that the corpus holds.
WATCHLIST = [
    Label("themes", "Interest Rates", ["from the", "this"], 10.0),
    Label("themes", "Inflation", ["was that", "nicht"], 9.0),
    Label("themes", "Currency", ["with the"], 8.0),
    Label("themes", "Growth", ["that the", "for the"], 7.0),
    Label("institutions", "RBI", ["was the", "dans"], 10.0),
    Label("institutions", "Government", ["by the"], 6.0),
    Label("sectors", "Banking & Financials", ["is the", "it was"], 5.0),
    Label("sectors", "Auto", ["and that", "avec"]),
    Label("companies", "First Company", ["was a", "pour"], None, "FIRST"),
    Label("companies", "Second Company", ["this the"], None, "SECOND"),
    Label("indices", "Nifty", ["as the", "que la"], 5.0),
]
NOISE = ("and the", "of that", "que de")
PAIR_THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("published_at"))
    n = F.substring("source", 4, 9).cast("int")
    # Before the join, which would shuffle and sort whole texts.
    title = F.array_join(F.slice("words", 1, 12), " ").alias("title")
    # A projection of its own, so that texts are cut into words once.
    d = d.withColumn("words", text.tokens(F.col("text"), 40))
    d = d.select("doc_id", "source", title, text.cap_words(F.col("text"), 40, F.col("words")).alias("snippet"))
    # Eight publishers to every thousand documents, so that capped tables grow with the corpus.
    publisher = F.concat(F.lit("pub"), (n % 8).cast("string"), F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string"))
    return d.join(e, "doc_id").select(
        F.col("doc_id").alias("id"), "title", "snippet",
        F.concat(F.lit("https://pub"), (n % 8).cast("string"), F.lit(".example/a/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("source_id"),
        F.concat(F.lit("Source "), n.cast("string")).alias("source_name"), publisher.alias("publisher"),
        F.element_at(F.array(*map(F.lit, TIERS)), n % 4 + 1).alias("source_tier"), "published_at",
    )


def as_of(rows: DataFrame) -> Column:
    """A minute after the newest article, as a literal."""
    newest = rows.agg(F.max("published_at").alias("m")).select((F.unix_micros("m") + 60_000_000).alias("m")).first().m
    return F.timestamp_micros(F.lit(newest or 0))


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles within their publishers' caps, less near duplicates."""
    # Written, as near duplicates read them more than once: texts are read and cut into words once.
    return similarity.near_duplicates(materialize(normalize.publisher_cap(articles(spark, sf_dir)), "capped"))


def pairs(rows: DataFrame) -> DataFrame:
    """As few links (a, b) as connect the articles of a story."""
    return similarity.class_links(*title_classes(rows, similarity.WINDOW_HOURS))


def title_classes(rows: DataFrame, hours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Members of classes of equal titles' grams, and pairs of similar classes; see similar_sets."""
    grams = rows.select("id", "published_at", text.word_grams(F.col("title")).alias("grams"))
    members, pairs = similarity.similar_sets(grams, PAIR_THRESHOLD, hours)
    return materialize(members, "members"), pairs


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh articles with their story."""
    rows = materialize(fresh(spark, sf_dir), "fresh")
    return stories.assign_stories(rows, pairs(rows))


def story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.stories(assigned(spark, sf_dir))


def story_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of each story, without its articles."""
    return stories.tag_by_article(stories.with_lead(assigned(spark, sf_dir)), WATCHLIST, F.concat("title", F.lit(" "), "snippet"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.tag(story_rows(spark, sf_dir), WATCHLIST, stories.story_text(F.col("articles")))


def published(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and URLs that an earlier run is taken to have published."""
    ids = rows.where(F.pmod("lead_id", F.lit(5)) == 0).select("story_id")
    urls = rows.select(F.explode("articles").alias("a")).where(F.pmod("a.id", F.lit(7)) == 0).select(F.col("a.url").alias("url"))
    return ids, urls


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(tagged(spark, sf_dir), "tagged")
    now = as_of(articles(spark, sf_dir))
    return stories.score(stories.seen_before(rows, *published(rows)), now, NOISE)


def _alias_sql(label: Label) -> str:
    inner = "|".join(label.aliases)
    return rf"regexp_matches(hay, '(?i)(^|[^\pL\pN_])({inner})($|[^\pL\pN_])')"


def _labels_sql(*groups: str) -> str:
    rows = [f"CASE WHEN {_alias_sql(x)} THEN '{x.label}' END" for g in groups for x in WATCHLIST if x.group == g]
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


def _weights_sql(column: str, default: float) -> str:
    table = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in stories.LABEL_WEIGHTS.items()) + "}"
    return f"coalesce(list_sum(list_transform({column}, lambda x: coalesce({table}[x], {default}))), 0.0)"


#: What the SQL of several queries starts with; each ends with its own SELECT.
SQL_STAGES = f"""
WITH RECURSIVE articles AS (
  SELECT d.doc_id AS id, array_to_string(w[1:12], ' ') AS title,
         CASE WHEN len(w) <= 40 THEN text ELSE rtrim(array_to_string(w[1:40], ' '), ',;:. ') || '…' END AS snippet,
         'https://pub' || (n % 8) || '.example/a/' || d.doc_id AS url, source AS source_id, 'Source ' || n AS source_name,
         'pub' || (n % 8) || '-' || (d.doc_id // 1000) AS publisher, ['wire', 'major', 'sectoral', 'aggregator'][n % 4 + 1] AS source_tier, e.ts AS published_at
  FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, CAST(substr(source, 4) AS INT) AS n FROM documents) d
  JOIN events e ON e.event_id = d.doc_id
), now AS (SELECT max(published_at) + INTERVAL 1 MINUTE AS as_of FROM articles
), grams AS (
  SELECT *, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS grams
  FROM (SELECT *, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM articles)
), capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY published_at DESC, id) AS rn FROM grams) WHERE rn <= 75
), numbered AS (
  SELECT id, publisher, grams, row_number() OVER (PARTITION BY publisher ORDER BY published_at, id) AS k FROM capped
), fold AS (
  SELECT publisher, k, [id] AS kept, [grams] AS held FROM numbered WHERE k = 1
  UNION ALL
  SELECT publisher, k, CASE WHEN dup THEN kept ELSE list_append(kept, id) END, CASE WHEN dup THEN held ELSE list_append(held, grams) END
  FROM (
    SELECT n.publisher, n.k, n.id, n.grams, f.kept, f.held, len(list_filter(f.held, lambda g: len(g) > 0 AND len(n.grams) > 0 AND
      len(list_intersect(g, n.grams)) >= 0.82 * (len(g) + len(n.grams) - len(list_intersect(g, n.grams))))) > 0 AS dup
    FROM fold f JOIN numbered n ON n.publisher = f.publisher AND n.k = f.k + 1)
), fresh AS (
  SELECT * FROM capped WHERE id IN (
    SELECT unnest(kept) FROM fold WHERE (publisher, k) IN (SELECT (publisher, max(k)) FROM fold GROUP BY publisher))
), one AS (SELECT id, published_at, unnest(grams) AS g, len(grams) AS n FROM fresh
), pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*)) AS sim FROM one a JOIN one b ON a.g = b.g AND a.id < b.id
    AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 64800000000
  GROUP BY a.id, b.id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.3
), reach AS (
  SELECT id, id AS other FROM fresh
  UNION SELECT r.id, CASE WHEN p.a = r.other THEN p.b ELSE p.a END FROM reach r JOIN pairs p ON r.other IN (p.a, p.b)
), component AS (SELECT id, min(other) AS story FROM reach GROUP BY id
), members AS (
  SELECT f.*, c.story, row_number() OVER (PARTITION BY c.story ORDER BY published_at, id) AS pos FROM fresh f JOIN component c USING (id)
), story AS (
  SELECT story, substr(sha1('cluster:' || arg_min(id, pos)), 1, 12) AS story_id, arg_min(id, pos) AS lead_id, arg_min(title, pos) AS headline,
         min(published_at) AS published_at, max(published_at) AS newest_at, count(DISTINCT publisher) AS n_publishers,
         count(DISTINCT source_id) AS n_feeds, count(*) AS n_articles, string_agg(title || ' ' || snippet, ' ' || chr(10) || ' ' ORDER BY pos) AS hay,
         string_agg(title, ' ' ORDER BY pos) AS titles
  FROM members GROUP BY story
), tagged AS (
  SELECT *, {_labels_sql("themes")} AS themes, {_labels_sql("institutions", "companies", "indices")} AS entities, {_labels_sql("sectors")} AS sectors,
         list_filter([{", ".join(f"CASE WHEN {_alias_sql(x)} THEN '{x.ticker}' END" for x in WATCHLIST if x.ticker)}], lambda x: x IS NOT NULL) AS tickers
  FROM story
), newest_tier AS (
  SELECT story, publisher, arg_max(source_tier, pos) AS tier FROM members GROUP BY story, publisher
), tier_sums AS (
  SELECT story, sum(CASE tier WHEN 'wire' THEN 3.0 WHEN 'major' THEN 2.0 WHEN 'sectoral' THEN 1.5 WHEN 'aggregator' THEN 0.8 ELSE 1.0 END) AS tier_sum
  FROM newest_tier GROUP BY story
), seen AS (
  SELECT story, bool_or(id % 7 = 0) AS url_seen FROM members GROUP BY story
), terms AS (
  SELECT t.*, 4.0 * ln(1 + CAST(s.tier_sum AS DOUBLE)) AS corroboration, {_weights_sql("themes", 5.0)} AS macro, {_weights_sql("entities", 3.0)} * 0.6 AS entity_term,
         {_weights_sql("sectors", 4.0)} * 0.4 AS sector_term,
         12.0 * exp(-greatest(0.0, (epoch_us(now.as_of) - epoch_us(t.newest_at)) / 3600000000.0) / 6.0) AS recency,
         CASE WHEN t.lead_id % 5 = 0 OR seen.url_seen THEN -25.0 ELSE 5.0 END AS novelty, (t.lead_id % 5 = 0 OR seen.url_seen) AS already_published,
         -6.0 * ({" + ".join(f"contains(lower(titles), '{p}')::INT" for p in NOISE)}) AS noise,
         CASE WHEN len(themes) + len(entities) + len(sectors) + len(tickers) = 0 THEN -8.0 END AS untagged
  FROM tagged t JOIN tier_sums s USING (story) JOIN seen USING (story), now
), scored AS (
  SELECT *, round(CAST(corroboration + macro + entity_term + sector_term + recency + novelty + noise + coalesce(untagged, 0.0) AS DOUBLE), 2) AS score FROM terms
)
"""
