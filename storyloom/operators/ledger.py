"""Compact facts derived from stories: recording, looking up, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators.normalize import first_seen

#: Kinds of events by theme, and those that an institution drives.
EVENT_TYPES = {
    "Interest Rates": "policy_rate", "Inflation": "inflation_print", "Currency": "currency_move", "Crude & Energy": "energy_price",
    "Fiscal & Budget": "fiscal_action", "Trade & Tariffs": "trade_action", "Institutional Flows": "fund_flows",
    "Credit & Liquidity": "credit_conditions", "Growth": "growth_print",
}
INSTITUTION_EVENTS = ("policy_rate", "credit_conditions", "fiscal_action")
RETENTION_DAYS = 400
RELATED = 6
KEY = ["date", "event_type", "entity"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def event_types(themes: Column) -> Column:
    """Kinds of events of themes, in order; themes without one vanish."""
    return F.array_compact(F.transform(themes, lambda t: _lookup(EVENT_TYPES, t)))


def facts(stories: DataFrame, date: Column) -> DataFrame:
    """Up to two facts per story (story_id, themes, entities, what_happened, and ord, their order)."""
    label = {v: k for k, v in EVENT_TYPES.items()}
    two = stories.select("*", F.posexplode(F.slice(event_types(F.col("themes")), 1, 2)).alias("k", "event_type"))
    by_institution = F.col("event_type").isin(*INSTITUTION_EVENTS) & (F.size("entities") > 0)
    entity = F.when(by_institution, F.try_element_at("entities", F.lit(1))).otherwise(F.coalesce(_lookup(label, F.col("event_type")), F.lit("market")))
    return two.select(
        date.cast("string").alias("date"), "event_type", entity.alias("entity"), text.magnitude(F.col("what_happened"), F.col("event_type")).alias("value"),
        F.col("story_id").alias("cluster_id"), "ord", "k",
    )


def record(ledger: DataFrame, stories: DataFrame, date: Column) -> DataFrame:
    """The ledger with new facts: none of a key that it has, and the first of each key."""
    new = first_seen(facts(stories, date), KEY, ["ord", "cluster_id", "k"]).join(ledger.select(*KEY), KEY, "left_anti")
    return ledger.select(*KEY, "value", "cluster_id").unionByName(new.select(*KEY, "value", "cluster_id"))


def prune(ledger: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return ledger.where(F.col("date") >= F.date_sub(as_of.cast("date"), days).cast("string"))


def related(ledger: DataFrame, stories: DataFrame, limit: int = RELATED) -> DataFrame:
    """Facts that share an entity (in any case) or a kind of event with a story, newest first, with
    rn. Two equality joins and their union, not one join on either.

    Before the joins the ledger keeps the newest ``limit`` facts for each entity and each kind: no
    story can show more, and no entity floods a join.
    """
    order = [F.desc("date"), F.asc("event_type"), F.asc("entity"), F.asc("cluster_id")]
    kept = ledger.select(*KEY, "value", "cluster_id", F.lower("entity").alias("who"))

    def newest(key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        return kept.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= limit).drop("n_")

    by_entity = stories.select("story_id", F.explode(F.array_distinct(F.transform("entities", lambda e: F.lower(e)))).alias("who")).join(newest("who"), "who")
    by_type = stories.select("story_id", F.explode(F.array_distinct(event_types(F.col("themes")))).alias("event_type")).join(newest("event_type"), "event_type")
    cols = ["story_id", *KEY, "value", "cluster_id"]
    both = by_entity.select(*cols).unionByName(by_type.select(*cols)).distinct()
    w = Window.partitionBy("story_id").orderBy(*order)
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def related_facts(found: DataFrame) -> DataFrame:
    """(story_id, facts) with the rows of related() in order."""
    fact = F.struct("rn", "date", F.col("event_type").alias("event"), "entity", "value")
    return found.groupBy("story_id").agg(F.array_sort(F.collect_list(fact)).alias("f")).select(
        "story_id", F.transform("f", lambda x: x.dropFields("rn")).alias("facts")
    )
