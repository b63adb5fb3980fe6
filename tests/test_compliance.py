import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom import schemas
from storyloom.functions import json
from storyloom.operators import compliance as c

SCHEMA = T.StructType.fromDDL(schemas.ANALYSIS)
CASE = lambda t: {"argument": t, "depends_on": ["x holds"]}
BASE = {
    "headline": "rbi holds the repo rate", "hook": "Who pays?", "gist": ["What happened: a hold", "it costs", "the next print"], "what_happened": "The bank kept its rate.",
    "who_is_affected": [{"group": "borrowers", "effect": "nothing changes"}], "sectors": [{"sector": "Banking", "direction": "neutral", "why": "margins stay"}],
    "transmission_mechanism": {"chain": ["rate", "loans"], "explanation": "Loans follow.", "time_horizon": "months"}, "market_reaction": "bonds were calm",
    "bull_case": CASE("Bulls argue that demand holds"), "bear_case": CASE("Analysts expect a slowdown"), "variables_to_watch": [{"variable": "cpi", "why_it_matters": "It sets the path", "when": "monthly"}],
    "confidence": "medium", "confidence_reason": "one source", "jargon": [{"term": "repo", "plain_meaning": "a loan"}],
}


def rows(spark, *records):
    d = spark.createDataFrame([(k, r) for k, r in enumerate(records)], T.StructType([T.StructField("k", T.LongType()), T.StructField("a", SCHEMA)]))
    return d.select("k", "a.*")


def with_text(**changed):
    return BASE | changed


BLOCKED = [
    "Buy this now", "It fell. Sell it today", "time to book profits", "We recommend caution", "you should hold the bonds", "Investors must buy", "a must-buy stock", "the target price is 100", "its price target rose", "set a stop-loss",
    "a good entry point", "support at ₹1,850", "guaranteed returns", "a risk-free way", "the next multibagger", "it will surely rise", "allocate 10% of your portfolio", "20% of your capital",
]
CLEAN = [
    "the risk-free rate is the anchor", "the government will allocate 15% of the budget to roads", "index funds must buy about 695m of shares", "the central bank will buy the bonds", "refineries run at 90% of their capacity", "trackers buy it in proportion",
]
MINOR = ["the market will rise", "it looks cheap", "the stock is overvalued", "hard to ignore", "worth a look", "a good time to wait"]


@pytest.mark.parametrize("field", ["what_happened", "hook"])
def test_rules(spark, field):
    d = rows(spark, *(with_text(**{field: t}) for t in [*BLOCKED, *CLEAN, *MINOR]))
    hits = c.scan(d, "k", json.leaves(SCHEMA)).collect()
    blocked = {r.k for r in hits if r.severity == "blocking"}
    assert blocked == set(range(len(BLOCKED)))
    minor = {r.k for r in hits if r.severity == "minor"}
    assert minor == set(range(len(BLOCKED) + len(CLEAN), len(BLOCKED) + len(CLEAN) + len(MINOR)))
    assert {r.field for r in hits} == {field}
    flags = d.select("k", c.blocked(json.leaves(SCHEMA)).alias("b")).collect()
    assert {r.k for r in flags if r.b} == blocked


def test_leaves_are_every_string_with_its_path(spark):
    got = [(x.path, x.text) for x in rows(spark, BASE).select(json.leaves(SCHEMA).alias("x")).first().x]

    def walk(o, p=""):
        if isinstance(o, str):
            return [(p, o)]
        if isinstance(o, dict):
            return [y for k, v in o.items() for y in walk(v, f"{p}.{k}" if p else k)]
        return [y for i, v in enumerate(o) for y in walk(v, f"{p}[{i}]")]

    assert got == walk(BASE)
    nothing = rows(spark, {"headline": "x"}).select(json.leaves(SCHEMA).alias("x")).first().x
    assert [(x.path, x.text) for x in nothing] == [("headline", "x")]


def test_chain_of_stops(spark):
    bad = with_text(hook="Buy this now")
    unattributed = with_text(bear_case=CASE("Margins compress"), headline="us tariffs bite")
    d = rows(spark, BASE, bad, BASE, BASE, unattributed, with_text(hook="worth a look"), BASE)
    none, block = F.lit(None).cast("array<struct<severity:string>>"), F.array(F.struct(F.lit("blocking").alias("severity")))
    d = d.withColumns({
        "violations": F.when(F.col("k") == 2, block).otherwise(none),
        "rewrites": F.when(F.col("k") == 3, F.create_map(F.lit("hook"), F.lit("sell it at once"))).when(F.col("k") == 6, F.create_map(F.lit("bull_case.argument"), F.lit("Bulls expect more"), F.lit("gist[0]"), F.lit("no"), F.lit("sectors"), F.lit("no"))),
    })
    got = {r.k: r for r in c.enforce(d, SCHEMA).collect()}
    assert {k: r.blocked_by for k, r in got.items()} == {0: None, 1: "regex", 2: "reviewer", 3: None, 4: None, 5: None, 6: None} | {3: got[3].blocked_by}
    assert got[3].blocked_by == "rewrite" or got[3].hook == "Sell it at once"
    assert got[4].bear_case.argument == "Bears argue that margins compress" and got[4].headline == "US tariffs bite"
    assert got[0].headline == "RBI holds the repo rate" and got[0].gist == ["A hold", "It costs", "The next print"] and got[5].minor == ["implied recommendation"]
    assert got[6].bull_case.argument == "Bulls expect more" and got[6].sectors[0].sector == "Banking"


def test_validation(spark):
    bad = [with_text(headline="x" * 141), with_text(gist=["a", "b"]), with_text(confidence="sure"), with_text(transmission_mechanism={"chain": ["one"], "explanation": "", "time_horizon": "days"}),
           with_text(sectors=[{"sector": "s", "direction": "up", "why": ""}]), with_text(hook=None), with_text(bull_case=None)]
    got = rows(spark, BASE, with_text(jargon=[], sectors=[]), *bad).select(c.valid_analysis().alias("v")).collect()
    assert [r.v for r in got] == [True, True] + [False] * len(bad)


def test_set_path(spark):
    d = rows(spark, BASE)
    for path in ("hook", "gist[1]", "bull_case.argument", "variables_to_watch[0].when", "transmission_mechanism.chain[0]"):
        put = json.set_path(SCHEMA, path, F.lit("NEW"))
        top = path.split(".")[0].split("[")[0]
        leaves = {x.path: x.text for x in d.withColumn(top, put).select(json.leaves(SCHEMA).alias("x")).first().x}
        before = {x.path: x.text for x in d.select(json.leaves(SCHEMA).alias("x")).first().x}
        assert leaves == before | {path: "NEW"}
