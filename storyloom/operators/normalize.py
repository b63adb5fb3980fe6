"""From raw entries of feeds to articles: one row per entry with the reason it was dropped, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import dates, text
from storyloom.shared import materialize

#: Titles that never become stories (any case, anywhere in the title).
HARD_EXCLUDES = (
    r"^\s*(buy|sell|hold|accumulate|reduce|add)\b.{0,60}\btarget\b", r"\btarget (price|of)\b", r"\b(buy|sell) call\b",
    r"\bstocks? to (buy|sell)\b", r"\btop (stock )?picks?\b", r"\bbuy or sell\b", r"\bshould you (buy|sell|invest)\b",
    r"\bmultibagger\b", r"\b(brokerage|analyst)s? (say|says|recommend)\b", r"\bstop loss\b", r"\bintraday (pick|call|trade|stock)",
    r"\btrade setup\b", r"\bmuhurat\b", r"\bapply or not\b", r"\bshould you (subscribe|apply)\b", r"\bIPO Day \d", r"\bGMP\b",
    r"\bgrey market premium\b", r"\bMoney Market Operations as on\b", r"\bVariable Rate (Reverse )?Repo\b", r"\bVRRR\b",
    r"\bauction under LAF\b", r"^Result of the .{0,40}auction\b", r"\b(91|182|364)[- ]day Treasury Bills?\b",
    r"\bAuction of State Government Securities\b", r"\bUnderwriting Auction\b", r"\bDaily Reference Rate\b",
    r"\bShare Price Live Updates\b", r"\bStock (Details|Price Overview)\b", r"\bMarket Engagement\b",
    r"\b(Nifty|Sensex|market).{0,30}\bprediction\b", r"\bhow .{0,30}(is|are) expected to trade\b", r"\bwhat lies ahead\b",
    r"\b(Release|Adjudication|Settlement|Prohibitive|Attachment) Order\b", r"\bRecovery Certificate\b", r"\bOrder in the matter of\b",
    r"\bshow cause notice\b", r"\b(gold|silver) (rate|price) today\b", r"\b(petrol|diesel) price(s)? today\b", r"\bprice prediction\b",
    r"\bclosing bell\b", r"\bamong \d+ (stocks|shares|companies)\b", r"\b\d+ (key )?things (you|to) (must|should) know\b",
    r"\byou must know\b", r"\bheatmap\b",
)

RETENTION_HOURS = 24
FUTURE_MINUTES = 30
MAX_PER_PUBLISHER = 75


def matches_any(value: Column, patterns) -> Column:
    """One pass over the value by one alternation, in any case; no patterns match nothing."""
    return value.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def ok_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.where(F.col("error").isNull() & (F.size("entries") > 0))


def with_defaults(sources: DataFrame, defaults: dict) -> DataFrame:
    """Sources with missing settings from the defaults; a publisher defaults to the source's id."""
    kinds = dict(sources.dtypes)
    for name, value in defaults.items():
        given = F.col(name) if name in kinds else F.lit(None)
        sources = sources.withColumn(name, F.coalesce(given, F.lit(value)))
    publisher = F.col("publisher") if "publisher" in kinds else F.lit(None).cast("string")
    return sources.withColumn("publisher", F.coalesce(publisher, F.col("id")))


def head_slice(entries: DataFrame, feed: str = "source_id", pos: str = "entry_pos", limit: str = "max_entries") -> DataFrame:
    """The first entries of each feed in its order; a feed's limit is a column."""
    w = Window.partitionBy(feed).orderBy(pos)
    return entries.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= F.col(limit)).drop("rn_")


def flatten(feeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries of ok feeds with their sources' settings, at most max_entries of each feed. The
    slice is on the array, so it needs no shuffle."""
    settings = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("tier").alias("source_tier"), "publisher",
        "snippet_max_words", "default_tz", "max_entries", *(["source_ord"] if "source_ord" in sources.columns else []),
    )
    joined = ok_feeds(feeds).join(settings, "source_id")
    return joined.select(
        *[c for c in settings.columns],
        F.posexplode(F.slice("entries", F.lit(1), F.col("max_entries"))).alias("entry_pos", "e"),
    ).select("*", "e.*").drop("e")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the order. Partial aggregation leaves one row per key and
    task before the shuffle, so a key that repeats without end is no burden."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("s_")).select(*keys, *(F.col("s_")[c].alias(c) for c in rest))


def publisher_cap(articles: DataFrame, limit: int = MAX_PER_PUBLISHER) -> DataFrame:
    """The newest of each masthead; the limit applies before the shuffle, too."""
    w = Window.partitionBy(text.masthead(F.col("publisher"), F.col("source_id"))).orderBy(F.desc("published_at"), "id")
    return articles.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= limit).drop("rn_")


def within_retention(ts: Column, as_of: Column, hours: int = RETENTION_HOURS) -> Column:
    return ts >= as_of - F.expr(f"INTERVAL {hours} HOURS")


def clamp_future(ts: Column, as_of: Column, minutes: int = FUTURE_MINUTES) -> Column:
    return F.when(ts > as_of + F.expr(f"INTERVAL {minutes} MINUTES"), as_of).otherwise(ts)


def judge(entries: DataFrame, as_of: Column, excludes=HARD_EXCLUDES) -> DataFrame:
    """Articles and the reason (drop_reason: bad, excluded, stale, dupe) why an entry isn't one.

    entries: the columns of flatten(). An id is claimed by the first entry in the order of sources
    and entries that gets that far, valid or not.
    """
    order = ["source_ord", "entry_pos"] if "source_ord" in entries.columns else ["source_id", "entry_pos"]
    title, link = text.clean_text(F.col("title")), F.coalesce("link", F.lit(""))
    raw = [F.col(c) for c in ("published", "updated", "created", "date", "dc_date") if c in entries.columns]
    base = entries.withColumns({"title": title, "link": link, "found_at": dates.published([], raw, F.col("default_tz"))})
    base = base.withColumn("undated", F.col("found_at").isNull())
    reason = (
        F.when((F.col("title") == "") | (F.col("link") == ""), "bad")
        .when(matches_any(F.col("title"), excludes), "excluded")
        .when(~within_retention(F.coalesce("found_at", as_of), as_of), "stale")
    )
    canon = text.canonical_url(F.col("link"))
    body = text.clean_text(F.coalesce(F.nullif("summary", F.lit("")), "description"))
    base = base.withColumns({"drop_reason": reason, "url": canon, "id": text.article_id(canon), "body": body})
    # Written once: texts and dates are read twice below.
    base = materialize(base, "entries")
    first = F.min_by(F.struct(*order), F.struct(*order)).alias("first_")
    firsts = base.where(F.col("drop_reason").isNull()).groupBy("id").agg(first)
    judged = base.join(firsts, "id", "left")
    dupe = F.when(F.col("drop_reason").isNull() & (F.struct(*order) != F.col("first_")), "dupe")
    snippet = text.cap_words(text.without_title(F.col("body"), F.col("title")), 40)
    if "snippet_max_words" in entries.columns:
        w = text.tokens(text.without_title(F.col("body"), F.col("title")))
        cut = F.concat(F.rtrim(F.array_join(F.slice(w, F.lit(1), F.col("snippet_max_words")), " "), F.lit(",;:. ")), F.lit("…"))
        snippet = F.when(F.size(w) <= F.col("snippet_max_words"), text.without_title(F.col("body"), F.col("title"))).otherwise(cut)
    return judged.select(
        "id", "title", snippet.alias("snippet"), "url", "source_id", "source_name", "source_tier", "publisher",
        clamp_future(F.coalesce("found_at", as_of), as_of).alias("published_at"), as_of.alias("fetched_at"),
        F.coalesce("drop_reason", dupe, F.when(~F.col("url").rlike("^https?://[^/]+"), "bad")).alias("drop_reason"), "undated", *order,
    )


def normalize(entries: DataFrame, as_of: Column, excludes=HARD_EXCLUDES, limit: int = MAX_PER_PUBLISHER) -> DataFrame:
    kept = judge(entries, as_of, excludes).where(F.col("drop_reason").isNull())
    return publisher_cap(kept.drop("drop_reason", "undated", "entry_pos", "source_ord"), limit)


def cap_counts(judged: DataFrame, limit: int = MAX_PER_PUBLISHER) -> DataFrame:
    """Kept entries of each masthead, and how many of them the cap drops."""
    masthead = text.masthead(F.col("publisher"), F.col("source_id")).alias("masthead")
    n = judged.where(F.col("drop_reason").isNull()).groupBy(masthead).agg(F.count(F.lit(1)).alias("n_kept"))
    return n.withColumn("n_capped", F.greatest(F.col("n_kept") - limit, F.lit(0)))


def drop_counts(judged: DataFrame) -> DataFrame:
    """Entries by reason, kept ones among them, and how many of these had no date."""
    return judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("undated").alias("n_undated")
    )
