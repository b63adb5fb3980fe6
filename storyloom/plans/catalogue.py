"""Every registered query of the story engine with its SQL counterpart.

A query takes (spark, sf_dir) and runs over its whole tables. Array results are joined to text and
times are written as text, so that both sides compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import bounds, dates, json, text
from storyloom.operators import archive, compliance, ledger, normalize, similarity, stories
from storyloom.plans.articles import (
    NOISE, SQL_STAGES, WATCHLIST, articles, as_of, assigned, fresh, pairs, published, scored, story_rows, story_tags, table, tagged, title_classes,
)
from storyloom.shared import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, staged: bool = True):
    """Registers a query under its function's name, with its SQL (after the shared stages)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = SQL_STAGES + sql if staged else sql
        return f

    return add


def stamp(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table in the plan itself."""
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


# --- articles -----------------------------------------------------------------------------------


@query(
    """SELECT id, title, snippet, url, source_id, publisher, source_tier, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published,
    len(regexp_extract_all(lower(title), '[a-z0-9]+')) AS n_words FROM articles"""
)
def articles_base(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "id", "title", "snippet", "url", "source_id", text.masthead(F.col("publisher"), F.col("source_id")).alias("publisher"), "source_tier",
        stamp("published_at").alias("published"), F.size(text.plain_words(F.col("title"))).cast("long").alias("n_words"),
    )


def _decode_sql(x: str) -> str:
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    return x


@query(
    f"""SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace({_decode_sql(_decode_sql("coalesce(html, '')"))}, '<[^>]+>', ' ', 'g'),
    '#39;', chr(39)), '&nbsp;', ' '), '[\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS plain
    FROM pages""",
    staged=False,
)
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html"), text.decode_common).alias("plain"))


CANON_SQL = """SELECT page_id, CASE WHEN len(kept) > 0 THEN base || '?' || array_to_string(kept, '&') ELSE base END AS canon FROM (
  SELECT page_id, split_part(bare, '?', 1) AS base, list_filter(string_split(CASE WHEN contains(bare, '?') THEN regexp_replace(bare, '^[^?]*\\?', '') ELSE '' END, '&'),
    lambda kv: kv <> '' AND NOT regexp_matches(lower(kv), '^(utm_|fbclid|gclid|ref|source)')) AS kept
  FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '') AS bare FROM pages))"""


@query(f"SELECT page_id, canon, substr(sha1(canon), 1, 16) AS article_id FROM ({CANON_SQL})", staged=False)
def canonical_url_id(spark, sf_dir):
    canon = table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canon"))
    return canon.select("page_id", "canon", text.article_id(F.col("canon")).alias("article_id"))


@query(
    f"""SELECT 'page' AS kind, canon AS k, min(page_id) AS first_id, count(*) AS n FROM ({CANON_SQL}) GROUP BY canon
    UNION ALL SELECT 'document', sha1(text), min(doc_id), count(*) FROM documents GROUP BY sha1(text)""",
    staged=False,
)
def dedup_first_seen(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), text.canonical_url(F.col("url")).alias("k"), F.col("page_id").alias("id"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.sha1("text").alias("k"), F.col("doc_id").alias("id"))
    rows = pages.unionByName(docs)
    first = normalize.first_seen(rows, ["kind", "k"], ["id"])
    return first.join(rows.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n")), ["kind", "k"]).select("kind", "k", F.col("id").alias("first_id"), "n")


EXCLUDES = (r"^the\b.{0,60}\bthat\b", r"\bnicht\b", r"\bque la\b")


def entries(spark, sf_dir):
    """Raw entries from the tables: page links, article titles, mail dates; some bad, old or repeated."""
    p = table(spark, sf_dir, "pages")
    a = articles(spark, sf_dir)
    n = p.select(F.col("page_id").alias("id"), "url")
    rows = a.select("id", "title", "snippet", "source_id", "source_name", "source_tier", "publisher", "published_at").join(n, "id", "left")
    link = F.when(F.col("id") % 11 == 0, F.lit("")).when(F.col("id") % 13 == 0, F.lit("https://same.example/story?utm_id=1")).otherwise(
        F.coalesce("url", F.concat(F.lit("https://d.example/"), F.col("id").cast("string")))
    )
    when = F.when(F.col("id") % 17 != 0, F.date_format("published_at", "dd MMM yyyy HH:mm:ss")).otherwise(F.lit("soon"))
    return rows.select(
        "source_id", "source_name", "source_tier", "publisher", F.lit("UTC").alias("default_tz"), F.col("id").cast("int").alias("entry_pos"), F.substring("source_id", 4, 9).cast("int").alias("source_ord"),
        F.when(F.col("id") % 19 == 0, F.lit("")).otherwise(F.col("title")).alias("title"), link.alias("link"), F.col("snippet").alias("summary"), F.lit(None).cast("string").alias("description"),
        when.alias("published"),
    )


JUDGED_SQL = f"""
, raw AS (
  SELECT a.id, CAST(substr(a.source_id, 4) AS INT) AS ord, CASE WHEN a.id % 19 = 0 THEN '' ELSE a.title END AS title,
    CASE WHEN a.id % 11 = 0 THEN '' WHEN a.id % 13 = 0 THEN 'https://same.example/story?utm_id=1' ELSE coalesce(p.url, 'https://d.example/' || a.id) END AS link,
    CASE WHEN a.id % 17 <> 0 THEN date_trunc('second', a.published_at) END AS found_at
  FROM articles a LEFT JOIN pages p ON p.page_id = a.id
), canon AS (SELECT page_id AS id, canon AS url FROM ({CANON_SQL.replace("FROM pages", "FROM (SELECT id AS page_id, link AS url FROM raw)")})
), step AS (
  SELECT r.*, c.url, CASE WHEN title = '' OR link = '' THEN 'bad'
    WHEN regexp_matches(title, '(?i)(?:^the(?:[^\\pL\\pN_]|[^\\pL\\pN_].{{0,58}}[^\\pL\\pN_])that(?:$|[^\\pL\\pN_]))|(?:(?:^|[^\\pL\\pN_])nicht(?:$|[^\\pL\\pN_]))|(?:(?:^|[^\\pL\\pN_])que la(?:$|[^\\pL\\pN_]))') THEN 'excluded'
    WHEN found_at < now.as_of - INTERVAL 24 HOURS THEN 'stale' END AS why
  FROM raw r JOIN canon c USING (id), now
), judged AS (
  SELECT *, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY url, why ORDER BY ord, id) > 1 THEN 'dupe' END) AS reason FROM step
)
"""


@query(JUDGED_SQL + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, count(*) FILTER (WHERE found_at IS NULL) AS n_undated FROM judged GROUP BY ALL")
def drop_reason_counts(spark, sf_dir):
    return normalize.drop_counts(normalize.judge(entries(spark, sf_dir), as_of(articles(spark, sf_dir)), EXCLUDES))


@query(
    JUDGED_SQL + """SELECT publisher AS masthead, count(*) AS n_kept, greatest(count(*) - 75, 0) AS n_capped
    FROM judged j JOIN articles a USING (id) WHERE reason IS NULL GROUP BY publisher"""
)
def cap_counts(spark, sf_dir):
    return normalize.cap_counts(normalize.judge(entries(spark, sf_dir), as_of(articles(spark, sf_dir)), EXCLUDES))


@query(JUDGED_SQL + "SELECT substr(sha1(url), 1, 16) AS id, url, title FROM judged WHERE reason IS NULL")
def normalized_articles(spark, sf_dir):
    judged = normalize.judge(entries(spark, sf_dir), as_of(articles(spark, sf_dir)), EXCLUDES)
    return judged.where(F.col("drop_reason").isNull()).select("id", "url", "title")


@query("SELECT id FROM articles WHERE NOT regexp_matches(title, '(?i)(?:^the(?:[^\\pL\\pN_]|[^\\pL\\pN_].{0,58}[^\\pL\\pN_])that(?:$|[^\\pL\\pN_]))|(?:(?:^|[^\\pL\\pN_])nicht(?:$|[^\\pL\\pN_]))|(?:(?:^|[^\\pL\\pN_])que la(?:$|[^\\pL\\pN_]))')")
def hard_exclude(spark, sf_dir):
    return articles(spark, sf_dir).where(~normalize.matches_any(F.col("title"), EXCLUDES)).select("id")


@query(
    """SELECT event_id, strftime(CASE WHEN ts > m + INTERVAL 30 MINUTES THEN m ELSE ts END, '%Y-%m-%d %H:%M:%S') AS at
    FROM events, (SELECT max(ts) - INTERVAL 2 DAYS AS m FROM events) WHERE ts >= m - INTERVAL 24 HOURS"""
    , staged=False,
)
def retention_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    m = F.timestamp_micros(F.lit(e.agg(F.max(F.unix_micros("ts")).alias("m")).first().m - 2 * 86_400_000_000))
    return e.where(normalize.within_retention(F.col("ts"), m)).select("event_id", stamp(normalize.clamp_future(F.col("ts"), m)).alias("at"))


@query("SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id) AS rn FROM articles) WHERE rn <= 40")
def feed_head_slice(spark, sf_dir):
    return normalize.head_slice(_in_feed_order(spark, sf_dir).withColumn("max_entries", F.lit(40))).select("source_id", "id")


def _in_feed_order(spark, sf_dir):
    """Articles with entry_pos, by which the newest of a source is its feed's first."""
    return articles(spark, sf_dir).withColumn("entry_pos", F.struct((-F.unix_micros("published_at")).alias("k"), "id"))


@query(
    """SELECT source_id, source_name, entry_pos, title, link FROM (
      SELECT source_id, 'Name of ' || source_id AS source_name, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id) - 1 AS entry_pos, title, url AS link,
        CAST(substr(source_id, 4) AS INT) AS n FROM articles) WHERE n % 5 <> 0 AND entry_pos < 10 + n % 7"""
)
def feed_entries(spark, sf_dir):
    """Feeds of at most 100 entries, some failed, flattened under their sources' settings."""
    a = normalize.head_slice(_in_feed_order(spark, sf_dir).withColumn("max_entries", F.lit(100)))
    one = F.struct("entry_pos", F.col("title").alias("title"), F.col("url").alias("link"))
    n = F.substring("source_id", 4, 9).cast("int")
    feeds = a.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: F.struct(e["title"].alias("title"), e["link"].alias("link"))).alias("entries"))
    feeds = feeds.withColumn("error", F.when(n % 5 == 0, "HTTP 500"))
    settings = feeds.select(F.col("source_id").alias("id"), F.concat(F.lit("Name of "), "source_id").alias("name"), F.lit("major").alias("tier"), (10 + n % 7).alias("max_entries"))
    settings = normalize.with_defaults(settings, {"snippet_max_words": 40, "default_tz": "UTC", "max_entries": 40})
    out = normalize.flatten(feeds, settings)
    return out.select("source_id", "source_name", F.col("entry_pos").cast("long").alias("entry_pos"), "title", "link")


@query("SELECT publisher, id FROM capped")
def publisher_cap(spark, sf_dir):
    return normalize.publisher_cap(articles(spark, sf_dir)).select("publisher", "id")


@query("SELECT id, array_to_string(list_sort(grams), '|') AS grams, len(grams) AS n FROM grams")
def title_ngrams(spark, sf_dir):
    g = text.word_grams(F.col("title"))
    return articles(spark, sf_dir).select("id", F.array_join(F.array_sort(g), "|").alias("grams"), F.size(g).cast("long").alias("n"))


# --- similarity ---------------------------------------------------------------------------------


def _classes_sql(near: str, pair: str = "", member: str = "") -> str:
    """Pairs of classes and their members, of classes (class_id, gs, run, n, s, e); pair and member: further columns."""
    return f""", x AS (SELECT class_id, n, s, e, unnest(gs) AS g, len(gs) AS m FROM cls)
    SELECT 'pair' AS part, a.class_id AS a, b.class_id AS b, round(count(*) / (a.m + b.m - count(*)), 6) AS sim, a.n AS n_a, b.n AS n_b{pair}
    FROM x a JOIN x b ON a.g = b.g AND a.class_id < b.class_id {near}
    GROUP BY a.class_id, b.class_id, a.m, b.m, a.n, b.n HAVING count(*) / (a.m + b.m - count(*)) >= 0.3
    UNION ALL SELECT 'member', c.class_id, r.id, CAST(1 AS DOUBLE), c.n, 1{member} FROM runs r JOIN cls c ON c.gs = r.gs AND c.run = r.run"""


def _classes(members, pairs, *more: str):
    """Both tables in one: a pair of classes, or a class and a member; more: the members' further columns."""
    one = members.select(F.lit("member").alias("part"), F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"), F.col("n").alias("n_a"), F.lit(1).cast("long").alias("n_b"), *more)
    return pairs.select(F.lit("pair").alias("part"), "a", "b", F.round("sim", 6).alias("sim"), "n_a", "n_b", *(F.lit(None).cast("long").alias(c) for c in more)).unionByName(one)


@query(
    """, runs AS (SELECT id, list_sort(grams) AS gs, 1 AS run FROM grams WHERE len(grams) > 0)
    , cls AS (SELECT gs, run, min(id) AS class_id, count(*) AS n, 0 AS s, 0 AS e FROM runs GROUP BY gs, run)""" + _classes_sql("")
)
def jaccard_pairs(spark, sf_dir):
    """Similar titles: pairs of classes of equal ones, and the classes' members."""
    return _classes(*title_classes(articles(spark, sf_dir)))


@query(
    """, r AS (SELECT id, list_sort(grams) AS gs, epoch_us(published_at) AS us FROM grams WHERE len(grams) > 0)
    , steps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY gs ORDER BY us, id) <= 64800000000 THEN 0 ELSE 1 END AS step FROM r)
    , runs AS (SELECT *, sum(step) OVER (PARTITION BY gs ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS run FROM steps)
    , cls AS (SELECT gs, run, min(id) AS class_id, count(*) AS n, min(us) AS s, max(us) AS e FROM runs GROUP BY gs, run)"""
    + _classes_sql("AND greatest(a.s, b.s) - least(a.e, b.e) <= 64800000000", ", CAST(NULL AS BIGINT) AS at", ", r.us")
)
def time_window_pairs(spark, sf_dir):
    """Similar titles within 18 hours: pairs of classes, which are runs of equal ones, and the classes' members.

    A member's row has its time in microseconds, so that no link is lost in its class: rows are linked exactly if their
    classes are one or a pair, and their times no further apart.
    """
    members, found = title_classes(articles(spark, sf_dir), similarity.WINDOW_HOURS)
    return _classes(members, found, "at")


@query("SELECT id FROM fresh")
def neardup_greedy(spark, sf_dir):
    return fresh(spark, sf_dir).select("id")


@query(
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.42""",
    staged=False,
)
def cosine_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return similarity.cosine_pairs(rows, 0.42).select("a", "b", F.round("sim", 6).alias("sim"))


STOP = ("the", "of", "and", "to", "in", "is", "that", "de", "la", "le")
EXTRA = ("this", "was")


def _tfidf_sql(texts: str) -> str:
    """Stages that end with weights, of texts (id, text)."""
    return f"""
tw AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}'), lambda x: x NOT IN {STOP}) AS w FROM ({texts})
), tt AS (SELECT id, unnest(w) AS term FROM tw UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM tw)
), tf AS (SELECT id, term, count(*) AS c FROM tt GROUP BY id, term
), dn AS (SELECT count(*) AS n FROM tw
), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), wx AS (SELECT tf.id, tf.term, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN dfs USING (term), dn WHERE df <= 0.6 * n
), wt AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM wx
), weights AS (SELECT * FROM wt WHERE term NOT IN {EXTRA})
"""


TFIDF_SQL = ", " + _tfidf_sql("SELECT id, title || ' ' || title || ' ' || snippet AS text FROM articles")


def _weights(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id", F.concat_ws(" ", "title", "title", "snippet").alias("text"))
    return similarity.tfidf_shared(rows, stop_words=STOP, extra_stop_words=EXTRA)


@query(
    "WITH " + _tfidf_sql("SELECT doc_id AS id, coalesce(text, '') AS text FROM documents")
    + "SELECT id, term, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, term) AS rn FROM weights) WHERE rn <= 5",
    staged=False,
)
def tfidf_topterms(spark, sf_dir):
    """The five heaviest terms of each whole document."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return similarity.tfidf_top(rows, 5, stop_words=STOP, extra_stop_words=EXTRA).select("id", "term", F.round("w", 6).alias("w"))


@query(TFIDF_SQL + "SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS sim FROM weights a JOIN weights b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.42")
def tfidf_similarity(spark, sf_dir):
    return similarity.tfidf_pairs(_weights(spark, sf_dir), 0.42).select("a", "b", F.round("sim", 6).alias("sim"))


# --- stories ------------------------------------------------------------------------------------

_REACH_SQL = """, reach2 AS (SELECT id, id AS other FROM vertex
  UNION SELECT r.id, CASE WHEN p.a = r.other THEN p.b ELSE p.a END FROM reach2 r JOIN alike p ON r.other IN (p.a, p.b))
SELECT id, min(other) AS story FROM reach2 GROUP BY id"""


def _stories_of(rows, found):
    return stories.assign_stories(rows, found.select("a", "b")).select("id", "story")


@query(
    TFIDF_SQL + """, vertex AS (SELECT id FROM articles), alike AS (SELECT a.id AS a, b.id AS b FROM weights a JOIN weights b ON a.term = b.term AND a.id < b.id
      JOIN articles x ON x.id = a.id JOIN articles y ON y.id = b.id WHERE abs(epoch_us(x.published_at) - epoch_us(y.published_at)) <= 64800000000
      GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.42)""" + _REACH_SQL
)
def tfidf_stories(spark, sf_dir):
    """Stories of all articles at the default threshold of terms, within 18 hours."""
    rows = articles(spark, sf_dir)
    return _stories_of(rows, similarity.tfidf_links(_weights(spark, sf_dir), 0.42, rows.select("id", "published_at")))


@query(
    """WITH RECURSIVE vertex AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, ts FROM embeddings JOIN events ON event_id = vec_id
    ), alike AS (SELECT a.id AS a, b.id AS b FROM vertex a JOIN vertex b ON a.id < b.id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 64800000000 AND list_cosine_similarity(a.v, b.v) >= 0.78)"""
    + _REACH_SQL, staged=False,
)
def embedding_stories(spark, sf_dir):
    """Stories of all embeddings at the default threshold of vectors, within 18 hours."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("published_at"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(e, "id")
    return _stories_of(rows, similarity.cosine_pairs(rows, 0.78, similarity.WINDOW_HOURS))



@query("SELECT id, story FROM component")
def story_components(spark, sf_dir):
    rows = materialize(fresh(spark, sf_dir), "fresh")
    return stories.assign_stories(rows, pairs(rows)).select("id", "story")


@query(
    """SELECT story_id, lead_id, headline, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, strftime(newest_at, '%Y-%m-%d %H:%M:%S') AS newest,
    n_articles FROM story"""
)
def clusters(spark, sf_dir):
    return story_rows(spark, sf_dir).select("story_id", "lead_id", "headline", stamp("published_at").alias("published"), stamp("newest_at").alias("newest"), "n_articles")


@query(
    """SELECT count(*) AS n_stories, count(*) FILTER (WHERE n_articles > 1) AS n_multi, max(n_publishers) AS most_publishers, max(n_feeds) AS most_feeds,
    CAST(sum(n_articles) AS BIGINT) AS n_articles FROM story"""
)
def source_counts(spark, sf_dir):
    return story_rows(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_stories"), F.count_if(F.col("n_articles") > 1).alias("n_multi"), F.max("n_publishers").alias("most_publishers"),
        F.max("n_feeds").alias("most_feeds"), F.sum("n_articles").alias("n_articles"),
    )


def _joined(*names):
    return [F.array_join(n, "|").alias(n) for n in names]


@query(
    """SELECT story_id, array_to_string(themes, '|') AS themes, array_to_string(entities, '|') AS entities, array_to_string(sectors, '|') AS sectors,
    array_to_string(tickers, '|') AS tickers FROM tagged"""
)
def watchlist_tags(spark, sf_dir):
    return story_tags(spark, sf_dir).select("story_id", *_joined("themes", "entities", "sectors", "tickers"))


@query("SELECT story_id, round(macro::DOUBLE, 6) AS macro, round(entity_term::DOUBLE, 6) AS entities, round(sector_term::DOUBLE, 6) AS sectors FROM terms")
def tag_weights(spark, sf_dir):
    d = stories.DEFAULT_WEIGHTS
    return story_tags(spark, sf_dir).select(
        "story_id", F.round(stories.weight_sum(F.col("themes"), d["themes"]), 6).alias("macro"), F.round(stories.weight_sum(F.col("entities"), d["entities"]) * 0.6, 6).alias("entities"),
        F.round(stories.weight_sum(F.col("sectors"), d["sectors"]) * 0.4, 6).alias("sectors"),
    )


@query("SELECT story_id, CAST(tier_sum AS DOUBLE) AS tier_sum, round(4.0 * ln(1 + CAST(tier_sum AS DOUBLE)), 6) AS corroboration FROM story JOIN tier_sums USING (story)")
def tier_corroboration(spark, sf_dir):
    return story_rows(spark, sf_dir).select("story_id", "tier_sum", F.round(4.0 * F.log1p("tier_sum"), 6).alias("corroboration"))


@query("SELECT id, round(12.0 * exp(-greatest(0.0, (epoch_us(as_of) - epoch_us(published_at)) / 3600000000.0) / 6.0), 6) AS recency FROM articles, now")
def recency_decay(spark, sf_dir):
    a = articles(spark, sf_dir)
    age = F.greatest(F.lit(0.0), dates.age_hours(F.col("published_at"), as_of(a)))
    return a.select("id", F.round(12.0 * F.exp(-age / stories.EFOLD_HOURS), 6).alias("recency"))


@query("SELECT story_id, CAST(-noise / 6.0 AS BIGINT) AS hits, CAST(noise AS DOUBLE) AS penalty FROM terms")
def noise_penalty(spark, sf_dir):
    hits = text.count_phrases(F.array_join(F.transform("articles", lambda a: a["title"]), " "), NOISE)
    return story_rows(spark, sf_dir).select("story_id", hits.cast("long").alias("hits"), (-6.0 * hits).alias("penalty"))


@query("SELECT story_id, already_published FROM terms")
def novelty_flag(spark, sf_dir):
    # Article by article: a story's articles in one row would be one task's, however many they are.
    own = materialize(stories.with_lead(assigned(spark, sf_dir)).select("story_id", "lead_id", "id", "url"), "stories")
    rows = own.select("story_id", "lead_id").distinct()
    ids, urls = rows.where(F.pmod("lead_id", F.lit(5)) == 0).select("story_id"), own.where(F.pmod("id", F.lit(7)) == 0).select("url")
    return stories.seen_before(rows, ids, urls, own.select("story_id", "url")).select("story_id", "already_published")


@query(
    """SELECT story_id, score, round(corroboration, 2) AS corroboration, round(CAST(macro AS DOUBLE), 2) AS macro, round(CAST(entity_term AS DOUBLE), 2) AS entities,
    round(CAST(sector_term AS DOUBLE), 2) AS sectors, round(recency, 2) AS recency, CAST(novelty AS DOUBLE) AS novelty, CAST(noise AS DOUBLE) AS noise,
    CAST(untagged AS DOUBLE) AS untagged FROM scored"""
)
def score_breakdown(spark, sf_dir):
    return scored(spark, sf_dir).select("story_id", "score", "breakdown.*")


RANKED_SQL = ", top AS (SELECT *, row_number() OVER (ORDER BY score DESC, newest_at DESC, story_id) AS rn FROM scored WHERE score > 0), best AS (SELECT *, rn <= 10 AS selected FROM top WHERE rn <= 15)"


@query(
    RANKED_SQL + """ SELECT rn, story_id, score, selected, (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS k FROM scored)
    WHERE k = (SELECT count(*) // 2 + 1 FROM scored)) AS median FROM best"""
)
def rank_topk(spark, sf_dir):
    rows = materialize(scored(spark, sf_dir), "scored")
    top = stories.shortlist(rows).select(F.col("rn").cast("long").alias("rn"), "story_id", "score", "selected")
    return top.crossJoin(F.broadcast(stories.upper_median(rows)))


@query(
    RANKED_SQL + """, tri AS (SELECT *, CASE WHEN lead_id % 3 <> 0 THEN CAST(lead_id % 100 AS DOUBLE) END AS t, lead_id % 4 = 0 AS dull FROM best),
    fair AS (SELECT *, score - CASE WHEN t IS NOT NULL AND dull THEN 20.0 ELSE 0.0 END AS s FROM tri)
    SELECT story_id, CASE WHEN t IS NOT NULL THEN round(0.5 * s + 0.5 * (t * 0.8), 2) ELSE s END AS score FROM fair"""
)
def triage_blend(spark, sf_dir):
    best = materialize(stories.shortlist(scored(spark, sf_dir)), "shortlist")
    reply = best.where(F.pmod("lead_id", F.lit(3)) != 0).select(
        "story_id", F.pmod("lead_id", F.lit(100)).cast("double").alias("triage_score"), (F.pmod("lead_id", F.lit(4)) != 0).alias("explainer_worthy")
    )
    return stories.blend_triage(best, reply).select("story_id", "score")


@query(
    RANKED_SQL + """ SELECT s.story_id AS id, coalesce(b.selected, FALSE) AS selected, s.score, s.n_articles, s.n_publishers, s.n_feeds,
    array_to_string(s.themes, '|') AS themes, (SELECT string_agg(title, '|' ORDER BY pos) FROM members m WHERE m.story = s.story) AS titles
    FROM scored s LEFT JOIN best b USING (story_id)"""
)
def dump_clusters(spark, sf_dir):
    rows = materialize(scored(spark, sf_dir), "scored")
    out = stories.dump(rows, stories.shortlist(rows).where("selected"))
    titles = F.array_join(F.transform("titles", lambda t: t["title"]), "|")
    return out.select("id", "selected", "score", "n_articles", "n_publishers", "n_feeds", F.array_join("tags.macro_themes", "|").alias("themes"), titles.alias("titles"))


@query(
    RANKED_SQL + """ SELECT strftime(as_of, '%Y-%m-%d %H:%M:%S') AS started, CAST(sum(n_articles) AS BIGINT) AS articles, count(*) AS clusters,
    count(*) FILTER (WHERE n_articles > 1) AS multi_article_clusters, (SELECT count(*) FROM best WHERE selected) AS selected FROM scored, now GROUP BY as_of"""
)
def run_summary(spark, sf_dir):
    rows = materialize(scored(spark, sf_dir), "scored")
    return stories.summary(rows, stories.shortlist(rows).where("selected"), stamp(as_of(articles(spark, sf_dir))))


@query(
    RANKED_SQL + """ SELECT story_id, headline, n_publishers AS source_count, array_to_string(list_concat(themes, entities, sectors), '|') AS tags,
    (SELECT string_agg(DISTINCT source_name, '|' ORDER BY source_name) FROM members m WHERE m.story = b.story) AS sources,
    CAST(round((epoch_us(as_of) - epoch_us(published_at)) / 60000000) AS BIGINT) AS age_minutes FROM best b, now"""
)
def triage_payload(spark, sf_dir):
    out = stories.triage_payload(stories.shortlist(scored(spark, sf_dir)), as_of(articles(spark, sf_dir)))
    return out.select("story_id", "headline", "source_count", *_joined("tags", "sources"), "age_minutes")


# --- compliance ---------------------------------------------------------------------------------

RULES = (
    ("blocking", r"\bthe that\b", "first rule"),
    ("blocking", r"(^|[.!?;]\s+)(and|of)\s+(the|a)\b", "second rule"),
    ("minor", r"\b(of|in|to|is|and) the\b", "third rule"),
    ("minor", r"\b\w+tion and\b", "fourth rule"),
)
MARKERS = ("with", "from", "avec", "nicht")

#: A whole conversation: its first turns under a record's names, all others in order.
RECORD_DDL = "headline string, hook string, bull_case struct<argument:string>, bear_case struct<argument:string>, turns array<string>"


def record_type() -> T.StructType:
    return T.StructType.fromDDL(RECORD_DDL)


def records(spark, sf_dir):
    """A record per conversation, of the whole text of every turn."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x["text"]).alias("all_"))
    case = lambda k: F.struct(F.coalesce(F.get("all_", F.lit(k)), F.lit("none")).alias("argument"))
    return c.select(
        "conv_id", F.get("all_", F.lit(0)).alias("headline"), F.get("all_", F.lit(1)).alias("hook"), case(2).alias("bull_case"), case(3).alias("bear_case"),
        F.slice("all_", F.lit(5), F.size("all_")).alias("turns"),
    )


RECORD_SQL = """
WITH c AS (SELECT conv_id, list(text ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id
), leaf AS (SELECT conv_id, unnest(list_concat([{'o': 0, 'path': 'headline', 'text': t[1]}, {'o': 1, 'path': 'hook', 'text': t[2]},
  {'o': 2, 'path': 'bull_case.argument', 'text': coalesce(t[3], 'none')}, {'o': 3, 'path': 'bear_case.argument', 'text': coalesce(t[4], 'none')}],
  list_transform(range(5, len(t) + 1), lambda i: {'o': i - 1, 'path': 'turns[' || (i - 5) || ']', 'text': t[i]}))) AS x FROM c
), leaves AS (SELECT conv_id, x.o AS o, x.path AS path, x.text AS text FROM leaf WHERE x.text IS NOT NULL)
"""


@query(RECORD_SQL + "SELECT conv_id, path, text FROM leaves", staged=False)
def flatten_leaves(spark, sf_dir):
    return records(spark, sf_dir).select("conv_id", F.explode(json.leaves(record_type())).alias("x")).select("conv_id", "x.*")


#: What a conversation's JSON has to keep, with bounds that some break.
TALK = bounds.Record(
    {
        "opening": bounds.Record({"role": bounds.Text(one_of=("user", "system")), "text": bounds.Text(most=350)}),
        "gist": bounds.Items(bounds.Text(), least=3, most=3),
        "turns": bounds.Items(bounds.Record({"role": bounds.Text(), "text": bounds.Text(most=1700)}), least=1, most=7),
        "close": bounds.Text(one_of=("assistant",), optional=True),
    }
)


@query(
    """WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id
    ), checks AS (SELECT conv_id, list_concat(
      CASE WHEN t[1].role NOT IN ('user', 'system') THEN [{'path': 'opening.role', 'problem': 'must be one of: user, system'}] ELSE [] END,
      CASE WHEN t[1].text IS NULL THEN [{'path': 'opening.text', 'problem': 'is missing'}]
        WHEN length(t[1].text) > 350 THEN [{'path': 'opening.text', 'problem': 'has ' || length(t[1].text) || ' characters, at most 350 may be'}] ELSE [] END,
      CASE WHEN len(t) < 4 THEN [{'path': 'gist', 'problem': 'has ' || (len(t) - 1) || ' items, at least 3 must be'}] ELSE [] END,
      CASE WHEN len(t) > 7 THEN [{'path': 'turns', 'problem': 'has ' || len(t) || ' items, at most 7 may be'}] ELSE [] END,
      list_filter(list_transform(range(1, len(t) + 1), lambda i: {'path': 'turns[' || (i - 1) || '].text', 'problem': CASE WHEN t[i].text IS NULL THEN 'is missing'
        WHEN length(t[i].text) > 1700 THEN 'has ' || length(t[i].text) || ' characters, at most 1700 may be' END}), lambda x: x.problem IS NOT NULL),
      CASE WHEN t[len(t)].role <> 'assistant' THEN [{'path': 'close', 'problem': 'must be one of: assistant'}] ELSE [] END) AS x FROM c)
    SELECT conv_id, x[1].path AS path, x[1].problem AS problem FROM checks""",
    staged=False,
)
def first_problems(spark, sf_dir):
    """Of each conversation, as JSON of its whole turns, the first broken bound and its path, or nulls."""
    turn = F.struct("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    said = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    talk = F.struct(
        F.get(said, F.lit(0)).alias("opening"), F.transform(F.slice("t", 2, 3), lambda x: x["text"]).alias("gist"), said.alias("turns"),
        F.element_at("t", -1)["role"].alias("close"),
    )
    found = c.select("conv_id", F.parse_json(F.to_json(talk)).alias("v"))
    return found.select("conv_id", bounds.first_problem(TALK, F.col("v")).alias("p")).select("conv_id", "p.path", "p.problem")


_RULES_SQL = sql_values([(s, p.replace(r"\w", r"[\pL\pN_]"), r) for s, p, r in RULES], "severity, pattern, rule").replace("\\b", "\\b")


@query(
    RECORD_SQL + f""", strings AS (SELECT 'conversations' AS source, conv_id AS id, path, text FROM leaves
      UNION ALL SELECT 'documents', doc_id, 'text', text FROM documents WHERE text IS NOT NULL),
    hit AS (SELECT l.source, l.id, l.path AS field, v.severity, v.rule, regexp_extract(l.text, '(?i)' || v.pattern) AS quote, l.text,
      length(regexp_extract(l.text, '(?is)^(.*?)(?:' || v.pattern || ')', 1)) + 1 AS p
      FROM strings l JOIN {_RULES_SQL} ON regexp_matches(l.text, '(?i)' || v.pattern))
    SELECT source, id, field, severity, rule, quote,
      CASE WHEN greatest(0, p - 1 - 70) > 0 THEN '…' ELSE '' END || trim(substr(text, greatest(0, p - 71) + 1, least(length(text), p - 1 + length(quote) + 70) - greatest(0, p - 71)), E' \\t\\n\\r')
      || CASE WHEN p - 1 + length(quote) + 70 < length(text) THEN '…' ELSE '' END AS context FROM hit""",
    staged=False,
)
def compliance_scan(spark, sf_dir):
    """Every string of whole conversations and documents."""
    c = compliance.scan(records(spark, sf_dir), "conv_id", json.leaves(record_type()), RULES).withColumnRenamed("conv_id", "id")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    d = compliance.scan(d, "id", json.leaves(T.StructType.fromDDL("text string")), RULES)
    return c.select(F.lit("conversations").alias("source"), "*").unionByName(d.select(F.lit("documents").alias("source"), "*"))


@query(
    f"""SELECT conv_id, turn, {" OR ".join(f"contains(lower(text), '{m}')" for m in MARKERS)} AS attributed,
    CASE WHEN {" OR ".join(f"contains(lower(text), '{m}')" for m in MARKERS)} OR trim(text) = '' THEN text
      ELSE 'Bulls argue that ' || CASE WHEN length(t) > 1 AND NOT (regexp_matches(t[1:4], '\\p{{Lu}}') AND NOT regexp_matches(t[1:4], '\\p{{Ll}}')) AND regexp_matches(t[2:2], '\\p{{Ll}}')
        THEN lower(t[1:1]) || t[2:] ELSE t END END AS repaired
    FROM (SELECT *, trim(text) AS t FROM conversations WHERE text IS NOT NULL)""",
    staged=False,
)
def attribution_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    return c.select("conv_id", "turn", text.is_attributed(F.col("text"), MARKERS).alias("attributed"), text.attribute(F.col("text"), "Bulls argue that ", MARKERS).alias("repaired"))


def _acronyms_sql(x: str) -> str:
    for a in sorted(text.ACRONYMS, key=len, reverse=True):
        # Twice, since neighbours share the character between them.
        for _ in range(2):
            x = rf"regexp_replace({x}, '(?i)(^|[^\pL\pN_\pM])({a})($|[^\pL\pN_\pM])', '\1{a}\3', 'g')"
    return x


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(x, '^\\p{{Ll}}') THEN upper(x[1:1]) || x[2:] ELSE x END AS fixed,
      CASE WHEN trim(regexp_replace(g, '(?i)^\\s*(what happened|why it matters|what to watch|watch(?: for)?)\\s*[:\\-–—]\\s*', '')) = '' THEN g
        ELSE trim(regexp_replace(g, '(?i)^\\s*(what happened|why it matters|what to watch|watch(?: for)?)\\s*[:\\-–—]\\s*', '')) END AS bullet
    FROM (SELECT doc_id, {_acronyms_sql("t")} AS x, CASE WHEN doc_id % 3 = 0 THEN 'What to watch: ' ELSE '' END || t AS g
      FROM (SELECT doc_id, 'the ai and api of ' || lower(text) AS t FROM documents WHERE lang = 'en'))""",
    staged=False,
)
def casing_repair(spark, sf_dir):
    """Whole English documents, as the acronyms are English."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.concat(F.lit("the ai and api of "), F.lower("text")).alias("t"))
    bullet = F.concat(F.when(F.col("doc_id") % 3 == 0, "What to watch: ").otherwise(""), "t")
    return d.select("doc_id", text.currency_and_capital(text.upper_acronyms(F.col("t"))).alias("fixed"), text.strip_gist_label(bullet).alias("bullet"))


_EDGE = r"[^\pL\pN_\pM]"


def _contextual_sql(x: str) -> str:
    """SQL has no lookaround: what stands beside a word is matched with it and put back."""
    beside = (
        ("(?i)", "", "us", rf"\s+(?:{text.COUNTRY_NOUNS})", "US"), ("", r"the\s", "us", "", "US"),
        ("(?i)", "", "it", rf"\s+(?:{text.INDUSTRY_NOUNS})", "IT"), ("", r"Indian\s", "it", "", "IT"),
    )
    for flags, before, word, after, acronym in beside:
        for _ in range(2):
            x = rf"regexp_replace({x}, '{flags}((?:^|{_EDGE}){before}){word}({after}(?:$|{_EDGE}))', '\1{acronym}\2', 'g')"
    return rf"regexp_replace({x}, '(?i)(^|{_EDGE})rs(\s+[\p{{Nd}}₹]|₹)', '\1Rs\2', 'g')"


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(x, '^\\p{{Ll}}') THEN upper(x[1:1]) || x[2:] ELSE x END AS fixed
    FROM (SELECT doc_id, {_contextual_sql(_acronyms_sql("'it services and the us, it was us dollars: ' || text"))} AS x FROM documents WHERE lang = 'en')""",
    staged=False,
)
def casing_contextual(spark, sf_dir):
    """Whole English documents, after words that are acronyms by what stands beside them, and such that aren't."""
    t = F.concat(F.lit("it services and the us, it was us dollars: "), F.col("text"))
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", text.fix_casing(t).alias("fixed"))


_BLOCKS = "regexp_matches(text, '(?i)\\bthe that\\b') OR regexp_matches(text, '(?i)(^|[.!?;]\\s+)(and|of)\\s+(the|a)\\b')"


@query(
    RECORD_SQL + f""", after AS (SELECT conv_id, o, path, CASE WHEN path = 'headline' AND conv_id % 4 = 1 THEN 'A plain headline' ELSE text END AS text FROM leaves
    ), flags AS (SELECT conv_id, bool_or({_BLOCKS}) AS hit,
      bool_and(contains(lower(text), 'with') OR contains(lower(text), 'from') OR contains(lower(text), 'avec') OR contains(lower(text), 'nicht'))
        FILTER (WHERE path IN ('bull_case.argument', 'bear_case.argument')) AS attributed FROM leaves GROUP BY conv_id
    ), small AS (SELECT conv_id, list(rule ORDER BY o, place) AS rules FROM (
      SELECT conv_id, o, 3 AS place, 'third rule' AS rule FROM after WHERE regexp_matches(text, '(?i)\\b(of|in|to|is|and) the\\b')
      UNION ALL SELECT conv_id, o, 4, 'fourth rule' FROM after WHERE regexp_matches(text, '(?i)\\b[\\pL\\pN_]+tion and\\b')) GROUP BY conv_id)
    SELECT conv_id, CASE WHEN hit THEN 'regex' WHEN conv_id % 10 = 3 THEN 'reviewer' WHEN NOT attributed THEN 'unattributed' END AS blocked_by,
      coalesce(array_to_string(rules[1:3], '|'), '') AS minor, CASE WHEN conv_id % 4 = 1 THEN 'A plain headline' END AS rewritten
    FROM flags LEFT JOIN small USING (conv_id)""",
    staged=False,
)
def enforce_pipeline(spark, sf_dir):
    """The whole chain over whole conversations: what blocks a record, its minor flags, its rewritten headline."""
    c = F.col("conv_id")
    severity = F.when(c % 10 == 3, "blocking").otherwise("minor")
    rows = records(spark, sf_dir).select(
        "*", F.array(F.struct(severity.alias("severity"))).alias("violations"), F.when(c % 4 == 1, F.create_map(F.lit("headline"), F.lit("A plain headline"), F.lit("a.b.c"), F.lit("no"))).alias("rewrites")
    )
    # The prefix holds no marker of this query, so that a case without one stays blocked.
    out = compliance.enforce(rows, record_type(), RULES, MARKERS)
    return out.select("conv_id", "blocked_by", F.array_join("minor", "|").alias("minor"), F.when(c % 4 == 1, F.col("headline")).alias("rewritten"))


# --- ledger -------------------------------------------------------------------------------------

VALUE_TEXT = """CASE l_linenumber % 4 WHEN 0 THEN 'rate cut by ' || CAST(l_quantity AS INT) || ' bps after talks' WHEN 1 THEN 'duty of ₹' || CAST(l_quantity AS INT) || ' lakh crore was due'
 WHEN 2 THEN 'shares fell ' || CAST(l_quantity AS INT) || '% as ' || repeat('x', 70) || ' inflation came to ' || l_linenumber || '%' ELSE 'growth of ' || CAST(l_quantity AS INT) || ' % in gdp' END"""
EVENT_TEXT = "CASE l_partkey % 4 WHEN 0 THEN 'policy_rate' WHEN 1 THEN 'fiscal_action' WHEN 2 THEN 'inflation_print' ELSE 'growth_print' END"


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE
      WHEN e = 'policy_rate' AND k = 0 THEN q || 'bps' WHEN e = 'fiscal_action' AND k = 1 THEN '₹' || q || ' lakh crore'
      WHEN e = 'inflation_print' AND k = 2 THEN l_linenumber || '%' WHEN e = 'growth_print' AND k = 3 THEN q || '%' END AS value
    FROM (SELECT *, {EVENT_TEXT} AS e, l_linenumber % 4 AS k, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem)""",
    staged=False,
)
def value_extract(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{VALUE_TEXT} AS t", f"{EVENT_TEXT} AS e")
    return lines.select("l_orderkey", "l_linenumber", text.magnitude(F.col("t"), F.col("e")).alias("value"))


LEDGER_ROWS = [
    ("2023-12-01", "policy_rate", "RBI", "25bps", "old1"), ("2024-01-05", "inflation_print", "Inflation", "4.4%", "old2"), ("2022-01-01", "growth_print", "Growth", None, "old3"),
    ("2024-01-02", "currency_move", "Currency", None, "old4"), ("2023-06-01", "policy_rate", "rbi", None, "old5"), ("2023-07-01", "policy_rate", "Government", "6.5%", "old6"),
]
LEDGER_SCHEMA = "date string, event_type string, entity string, value string, cluster_id string"
LEDGER_NAMES = "date, event_type, entity, value, cluster_id"
EVENTS_SQL = sql_values(list(ledger.EVENT_TYPES.items()), "theme, event_type").replace("AS v(", "AS em(")
FACTS_SQL = f"""
, fact AS (SELECT story_id, lead_id, newest_at, entities, list_filter(list_transform(themes, lambda t: MAP {{ {", ".join(f"'{k}': '{v}'" for k, v in ledger.EVENT_TYPES.items())} }}[t]), lambda e: e IS NOT NULL) AS types FROM tagged
), two AS (SELECT story_id, lead_id, newest_at, entities, types[k] AS event_type, k FROM (SELECT *, unnest(range(1, least(2, len(types)) + 1)) AS k FROM fact)
), named AS (SELECT t.*, CASE WHEN event_type IN ('policy_rate', 'credit_conditions', 'fiscal_action') AND len(entities) > 0 THEN entities[1] ELSE em.theme END AS entity,
  CASE WHEN event_type = 'policy_rate' THEN (lead_id % 50) || 'bps' END AS value FROM two t JOIN {EVENTS_SQL} USING (event_type)
), old AS (SELECT * FROM {sql_values(LEDGER_ROWS, LEDGER_NAMES)}
), new AS (SELECT '2024-01-05' AS date, event_type, entity, value, story_id AS cluster_id, row_number() OVER (PARTITION BY event_type, entity ORDER BY lead_id, story_id, k) AS rn FROM named
), ledger AS (SELECT * FROM old UNION ALL SELECT date, event_type, entity, value, cluster_id FROM new n WHERE rn = 1 AND NOT EXISTS
  (SELECT 1 FROM old o WHERE o.date = n.date AND o.event_type = n.event_type AND o.entity = n.entity))
"""


def _facts(spark, sf_dir):
    rows = materialize(tagged(spark, sf_dir), "tagged").withColumn("ord", F.col("lead_id"))
    return rows.withColumn("what_happened", F.concat(F.lit("a cut of "), F.pmod("lead_id", F.lit(50)).cast("string"), F.lit(" bps")))


@query(FACTS_SQL + "SELECT * FROM ledger")
def ledger_record(spark, sf_dir):
    return ledger.record(values(spark, LEDGER_ROWS, LEDGER_SCHEMA), _facts(spark, sf_dir), F.lit("2024-01-05"))


@query(
    FACTS_SQL + """, hit AS (SELECT f.story_id, l.*, row_number() OVER (PARTITION BY f.story_id ORDER BY l.date DESC, l.event_type, l.entity, l.cluster_id) AS rn
      FROM fact f JOIN old l ON list_contains(list_transform(f.entities, lambda e: lower(e)), lower(l.entity)) OR list_contains(f.types, l.event_type))
    SELECT story_id, date, event_type, entity, value, cluster_id, rn FROM hit WHERE rn <= 3"""
)
def ledger_related(spark, sf_dir):
    found = ledger.related(values(spark, LEDGER_ROWS, LEDGER_SCHEMA), tagged(spark, sf_dir), 3)
    return found.withColumn("rn", F.col("rn").cast("long"))


@query(f"SELECT * FROM {sql_values(LEDGER_ROWS, LEDGER_NAMES)} WHERE date >= strftime(DATE '2024-01-05' - 400, '%Y-%m-%d')", staged=False)
def ledger_prune(spark, sf_dir):
    return ledger.prune(values(spark, LEDGER_ROWS, LEDGER_SCHEMA), F.lit("2024-01-05"))


# --- published items ----------------------------------------------------------------------------


def items(spark, sf_dir):
    """Published items: an article each, updated some hours later; neighbours of one source may share URLs."""
    a = articles(spark, sf_dir)
    k = F.col("id")
    urls = F.array(F.concat(F.lit("u"), F.floor(k / 3).cast("string")), F.concat(F.lit("v"), F.floor((k + 1) / 4).cast("string")))
    urls = F.when(k % 5 == 0, F.array(F.lit(""))).otherwise(urls)
    source = lambda u: F.struct(F.col("source_name").alias("name"), F.col("title").alias("headline"), u.alias("url"), F.col("published_at").cast("string").alias("published_at"))
    words = lambda n, m: F.array_join(F.slice(text.tokens(F.col("snippet")), n, m), " ")
    empty = F.array().cast("array<string>")
    tags = F.struct(empty.alias("entities"), empty.alias("tickers"), F.slice(text.tokens(F.col("title")), 1, 6).alias("sectors"), F.slice(text.tokens(F.col("title")), 2, 5).alias("macro_themes"))
    return a.select(
        F.concat(F.lit("c"), F.lpad(k.cast("string"), 9, "0")).alias("cluster_id"), F.struct(F.col("title").alias("headline"), words(1, 8).alias("hook"), F.array(words(1, 3), words(4, 3), words(7, 3)).alias("gist")).alias("analysis"),
        tags.alias("tags"), F.transform(urls, source).alias("sources"), "published_at", (F.col("published_at") + F.expr("INTERVAL 1 HOUR") * (k % 7)).alias("updated_at"),
        F.lit("medium").alias("confidence"), F.lit("free").alias("tier"),
    )


ITEMS_SQL = """
, items AS (SELECT id, 'c' || lpad(CAST(id AS VARCHAR), 9, '0') AS cluster_id, title, list_filter(string_split_regex(snippet, '\\s+'), lambda x: x <> '') AS sw,
  string_split(title, ' ') AS tw, CASE WHEN id % 5 = 0 THEN [] ELSE ['u' || (id // 3), 'v' || ((id + 1) // 4)] END AS urls,
  CASE WHEN id % 5 = 0 THEN 1 ELSE 2 END AS n_sources, published_at, published_at + INTERVAL 1 HOUR * (id % 7) AS updated_at FROM articles)
"""


@query(ITEMS_SQL + "SELECT cluster_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published FROM items, now WHERE published_at >= as_of - INTERVAL 24 HOURS")
def archive_load(spark, sf_dir):
    return archive.carry_forward(items(spark, sf_dir), as_of(articles(spark, sf_dir))).select("cluster_id", stamp("published_at").alias("published"))


@query(
    ITEMS_SQL + """, pool AS (SELECT cluster_id, urls, CASE WHEN id % 6 = 0 THEN updated_at + INTERVAL 5 HOURS ELSE updated_at END AS updated_at, published_at FROM items),
    numbered_items AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, cluster_id) AS k FROM pool WHERE len(urls) > 0),
    walk AS (
      SELECT k, cluster_id, urls AS claimed, TRUE AS kept FROM numbered_items WHERE k = 1
      UNION ALL
      SELECT n.k, n.cluster_id, CASE WHEN len(list_intersect(w.claimed, n.urls)) > 0 THEN w.claimed ELSE list_concat(w.claimed, n.urls) END, len(list_intersect(w.claimed, n.urls)) = 0
      FROM walk w JOIN numbered_items n ON n.k = w.k + 1)
    SELECT p.cluster_id, strftime(p.updated_at, '%Y-%m-%d %H:%M:%S') AS updated FROM pool p LEFT JOIN walk USING (cluster_id) WHERE len(p.urls) = 0 OR walk.kept"""
)
def archive_merge(spark, sf_dir):
    previous = items(spark, sf_dir)
    number = F.substring("cluster_id", 2, 9).cast("long")
    new = previous.where(number % 6 == 0).withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 5 HOURS"))
    return archive.merge(new, previous).select("cluster_id", stamp("updated_at").alias("updated"))


@query(
    ITEMS_SQL + """ SELECT cluster_id, title AS headline, array_to_string(sw[1:8], ' ') AS hook, array_to_string([array_to_string(sw[1:3], ' '), array_to_string(sw[4:6], ' '), array_to_string(sw[7:9], ' ')], '|') AS gist,
    'story/' || cluster_id || '.html' AS url, 'api/v1/clusters/' || cluster_id || '.json' AS api, array_to_string(tw[1:4], '|') AS sectors, array_to_string(tw[2:4], '|') AS themes,
    n_sources || ' source' || CASE WHEN n_sources = 1 THEN '' ELSE 's' END AS source_label,
    array_to_string([array_to_string(sw[1:3], ' '), array_to_string(sw[4:6], ' '), array_to_string(sw[7:9], ' ')], ' ') AS description,
    CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m // 60 < 24 THEN (m // 60) || ' hour' || CASE WHEN m // 60 = 1 THEN '' ELSE 's' END || ' ago'
      ELSE strftime(published_at, '%d %b, %H:%M') || ' UTC' END AS published_human
    FROM (SELECT *, CAST(floor((epoch_us(as_of) - epoch_us(published_at)) / 60000000) AS BIGINT) AS m FROM items, now)"""
)
def feed_index(spark, sf_dir):
    rows = items(spark, sf_dir)
    now = as_of(articles(spark, sf_dir))
    cards = archive.cards(rows, now).select("cluster_id", "published_human", *_joined("sectors", "themes"), "source_label", "description")
    feed = archive.feed_items(rows).select("cluster_id", "headline", "hook", F.array_join("gist", "|").alias("gist"), "url", "api")
    return feed.join(cards, "cluster_id")


@query(
    ITEMS_SQL + """SELECT strftime(any_value(as_of), '%Y-%m-%d %H:%M:%S') AS generated_at, 24 AS retention_hours, 'not advice' AS disclaimer, CAST(count(*) AS INT) AS count,
      string_agg(cluster_id || ' ' || title || ' story/' || cluster_id || '.html', '|' ORDER BY published_at DESC, cluster_id) AS items
    FROM items, now WHERE published_at >= as_of - INTERVAL 24 HOURS"""
)
def feed_envelope(spark, sf_dir):
    """The front page's one document, of the items within the retention window."""
    now = as_of(articles(spark, sf_dir))
    row = archive.feed_index(archive.carry_forward(items(spark, sf_dir), now), now, "not advice")
    shown = F.transform("items", lambda x: F.concat_ws(" ", x["cluster_id"], x["headline"], x["url"]))
    return row.select(stamp(F.col("generated_at").cast("timestamp")).alias("generated_at"), "retention_hours", "disclaimer", "count", F.array_join(shown, "|").alias("items"))


@query(ITEMS_SQL + "SELECT count(*) AS n_items, count(*) FILTER (WHERE published_at < as_of - INTERVAL 24 HOURS) AS n_late, count(*) FILTER (WHERE published_at < as_of - INTERVAL 24 HOURS) = 0 AS ok FROM items, now")
def retention_audit(spark, sf_dir):
    return archive.retention_audit(items(spark, sf_dir), as_of(articles(spark, sf_dir)))


# --- settings, providers, replies -----------------------------------------------------------------

SOURCES = [("a", "A", "pub", 30, None), ("b", "B", None, None, "Europe/Berlin"), ("c", "C", None, None, None)]


@query(
    f"""SELECT id, name, coalesce(publisher, id) AS publisher, coalesce(snippet_max_words, 40) AS snippet_max_words, coalesce(default_tz, 'Asia/Kolkata') AS default_tz, 40 AS max_entries
    FROM {sql_values(SOURCES, "id, name, publisher, snippet_max_words, default_tz")}""",
    staged=False,
)
def config_merge(spark, sf_dir):
    rows = values(spark, SOURCES, "id string, name string, publisher string, snippet_max_words int, default_tz string")
    return normalize.with_defaults(rows, {"snippet_max_words": 40, "default_tz": "Asia/Kolkata", "max_entries": 40})


MODELS = [("m1", "p1", "K1", " x ", "0", "0", 8), ("m2", "p2", "K2", "", "0", "0", 32), ("m3", "p3", "K3", "y", "0.1", "0", 64), ("m4", "p4", "K3", "y", "0", "free", 4), ("m5", "p5", "K4", "z", "0.0", "0", 16)]


@query(
    f"""SELECT model, provider, row_number() OVER (ORDER BY context DESC, model) AS rn FROM {sql_values(MODELS, "model, provider, key_env, key, prompt, completion, context")}
    WHERE trim(key) <> '' AND provider NOT IN ('p5') AND coalesce(try_cast(prompt AS DOUBLE) = 0 AND try_cast(completion AS DOUBLE) = 0, FALSE)""",
    staged=False,
)
def provider_filter(spark, sf_dir):
    from storyloom.sources.providers import live, zero_cost

    rows = values(spark, MODELS, "model string, provider string, key_env string, key string, prompt string, completion string, context int")
    kept = zero_cost(live(rows, values(spark, [("p5",)], "provider string")))
    return kept.select("model", "provider", F.row_number().over(Window.orderBy(F.desc("context"), "model")).cast("long").alias("rn"))


@query(
    f"""SELECT string_agg(key_env || '=' || CASE WHEN ok THEN 'set' ELSE 'MISSING' END, ' ' ORDER BY key_env) AS status
    FROM (SELECT key_env, bool_or(trim(key) <> '') AS ok FROM {sql_values(MODELS, "model, provider, key_env, key, prompt, completion, context")} GROUP BY key_env)""",
    staged=False,
)
def key_status(spark, sf_dir):
    from storyloom.sources.providers import key_status as status

    return status(values(spark, MODELS, "model string, provider string, key_env string, key string, prompt string, completion string, context int"))


REPLIES = [
    (1, '```json\n{"a": 1}\n```'), (2, '```\n{"a": 2}\n```'), (3, 'Here it is: {"a": 3}'), (4, '{"a": 4} and so on'), (5, '{"a": 5}'), (6, '{"t": "the "risk-free" rate", "a": 6}'),
    (7, '{"a": [7, ], }'), (8, '{"t": "one, two: {three}", "a": 8}'), (9, '{"t": "a \\"quoted\\" word", "a": 9}'), (10, "no object here"), (11, None),
]


@query()
def json_tolerant(spark, sf_dir):
    found = values(spark, REPLIES, "k int, reply string").select("k", json.tolerant_json(F.col("reply")).alias("parsed"))
    return found.select("k", "parsed", F.parse_json("parsed").isNotNull().alias("ok"))


RANKINGS = ['{"ranked": [{"cluster_id": "x", "score": 1.5}, {"score": 3}]}', '[{"cluster_id": "y", "score": 2.0}, {"cluster_id": "z"}]', "nothing"]


@query(
    f"""SELECT row ->> '$.cluster_id' AS story_id, CAST(row ->> '$.score' AS DOUBLE) AS score FROM (
      SELECT unnest(from_json(CASE WHEN json_type(reply) = 'ARRAY' THEN reply::JSON ELSE json_extract(reply, '$.ranked') END, '["JSON"]')) AS row
      FROM {sql_values([(r,) for r in RANKINGS], "reply")} WHERE json_valid(reply)) WHERE row ->> '$.cluster_id' IS NOT NULL""",
    staged=False,
)
def triage_rows(spark, sf_dir):
    rows = values(spark, [(r,) for r in RANKINGS], "reply string").select(F.explode(json.ranked_rows(F.col("reply"))).alias("r"))
    return rows.select(F.col("r.cluster_id").alias("story_id"), F.col("r.score").alias("score"))


DATES = [
    (1, "Tue, 11 Aug 2026 10:30:00 GMT"), (2, "Tue, 11 Aug 2026 10:30:00"), (3, "11 Aug 2026 10:30:00 +0530"), (4, "2026-08-11T10:30:00Z"), (5, "2026-08-11T10:30:00+05:30"),
    (6, "2026-08-11T10:30:00"), (7, "2026-08-11 10:30:00"), (8, "Tue, 11 Aug 2026 10:30 EST"), (9, "11 Aug 26 10:30:00 IST"), (10, "yesterday"), (11, "31 Feb 2026 10:30:00"), (12, "Tue, 11 Aug 2026 10:30:00 -0000"),
]


@query(
    f"""SELECT k, strftime(local - to_minutes(CASE WHEN zone IN ('GMT', 'Z') THEN 0 WHEN zone = 'EST' THEN -300 WHEN zone IN ('', 'IST', '-0000') THEN 330
        ELSE (CASE WHEN zone[1:1] = '-' THEN -1 ELSE 1 END) * (CAST(replace(zone, ':', '')[2:3] AS INT) * 60 + CAST(replace(zone, ':', '')[4:5] AS INT)) END), '%Y-%m-%d %H:%M:%S') AS utc
    FROM (SELECT k, regexp_extract(raw, '(GMT|EST|IST|Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') AS zone,
      try_strptime(trim(regexp_replace(regexp_replace(raw, '(GMT|EST|IST|Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', ''), '^[A-Za-z]+, ', '')),
        ['%d %b %y %H:%M:%S', '%d %b %Y %H:%M:%S', '%d %b %Y %H:%M', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S']) AS local
      FROM {sql_values(DATES, "k, raw")})""",
    staged=False,
)
def date_ladder(spark, sf_dir):
    rows = values(spark, DATES, "k int, raw string")
    return rows.select("k", stamp(dates.parse_date(F.col("raw"), F.lit("Asia/Kolkata"))).alias("utc"))
