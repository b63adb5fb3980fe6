"""Rule scans over every string of a record, attribution, and the chain that clears a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import json, text
from storyloom.functions.bounds import Items, Record, Text

#: Fixed values: (severity, pattern, rule).
RULES = (
    ("blocking", r"(^|[.!?;]\s+)(buy|sell|short|accumulate)\s+(this|these|the|it|now|at)\b", "direct recommendation"),
    ("blocking", r"\bbook (profits?|losses?)\b", "direct recommendation"),
    ("blocking", r"\b(we|our|i)\s+(recommend|suggest|advise|would (buy|sell|avoid))\b", "first-person advice"),
    ("blocking", r"\byou should (buy|sell|hold|invest|avoid|exit|book|consider buying)\b", "second-person instruction"),
    ("blocking", r"\b(you|investors?|traders?|shareholders?|readers?|one)\s+(must|should)\s+buy\b", "imperative recommendation"),
    ("blocking", r"\bmust[- ]buy\s+(stocks?|shares?|picks?|counters?)\b", "imperative recommendation"),
    ("blocking", r"\btarget (price|of)\b", "price target"),
    ("blocking", r"\bprice target\b", "price target"),
    ("blocking", r"\bstop[- ]loss\b", "stop loss"),
    ("blocking", r"\b(entry|exit) (point|level|price)\b", "entry/exit level"),
    ("blocking", r"\b(support|resistance) (at|level of)\s*(rs\.?|₹|inr)?\s*[\d,]+", "technical level"),
    ("blocking", r"\b(guaranteed?|assured|sure[- ]shot|no[- ]risk)\b", "guarantee language"),
    ("blocking", r"\brisk[- ]free\b(?!\s+rate\b)", "guarantee language"),
    ("blocking", r"\bmultibagger\b", "guarantee language"),
    ("blocking", r"\bwill (definitely|certainly|surely)\b", "certainty language"),
    ("blocking", r"\ballocate\s+\d{1,3}\s*%\s+(of\s+)?(your|their|the\s+)?\s*(portfolio|capital|corpus|holdings|investments?)\b", "allocation advice"),
    ("blocking", r"\b\d{1,3}\s*% of your (portfolio|capital|corpus|holdings)\b", "allocation advice"),
    ("minor", r"\b(this|the stock|the sector|the market) (will|is going to) (rise|fall|rally|crash|surge|drop)\b", "unattributed prediction"),
    ("minor", r"\blooks (attractive|cheap|expensive|compelling)\b", "implied valuation call"),
    ("minor", r"\b(undervalued|overvalued)\b", "implied valuation call"),
    ("minor", r"\bhard to ignore\b", "implied recommendation"),
    ("minor", r"\bworth (a look|considering|watching closely for entry)\b", "implied recommendation"),
    ("minor", r"\bgood (time|opportunity) to\b", "implied timing call"),
)
#: What tells that a case is someone else's view, and what a repair puts before one.
MARKERS = (
    "argue", "argues", "arguing", "contend", "contends", "point to", "points to", "expect", "expects", "according to", "analysts",
    "bulls", "bears", "optimists", "pessimists", "investors", "market participants", "case rests", "case hinges", "case is that",
    "case for", "case against", "those who", "proponents", "skeptics", "sceptics",
)
PREFIXES = {"bull_case": "Bulls argue that ", "bear_case": "Bears argue that "}

HIT = "array<struct<field:string,severity:string,rule:string,quote:string,context:string>>"


def hits(path: Column, value: Column, rules=RULES) -> Column:
    """The first match of each rule in a string, with what stands around it."""
    found = []
    for severity, pattern, rule in rules:
        p = F.lit("(?iU)" + pattern)
        at = F.regexp_instr(value, p)
        quote = F.regexp_substr(value, p)
        found.append(
            F.when(
                at > 0,
                F.struct(path.alias("field"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), quote.alias("quote"), text.context(value, at, F.length(quote)).alias("context")),
            )
        )
    return F.array_compact(F.array(*found)) if found else F.array().cast(HIT)


def suspicious(value: Column, rules=RULES) -> Column:
    """Whether any rule matches: one alternation, so clean strings are passed once."""
    return value.rlike("(?iU)" + "|".join(f"(?:{p})" for _, p, _ in rules)) if rules else F.lit(False)


def scan(rows: DataFrame, key: str, leaves: Column, rules=RULES) -> DataFrame:
    """A row per string and rule that matches: key, field, severity, rule, quote, context.

    leaves: array<struct<path,text>> (functions.json.leaves). Rules are literals in the projection,
    so nothing is joined or shuffled.
    """
    flat = rows.select(key, F.explode(leaves).alias("leaf")).select(key, F.col("leaf.path").alias("path"), F.col("leaf.text").alias("text"))
    flat = flat.where(suspicious(F.col("text"), rules))
    return flat.select(key, F.explode(hits(F.col("path"), F.col("text"), rules)).alias("h")).select(key, "h.*")


def blocked(leaves: Column, rules=RULES) -> Column:
    """Whether a blocking rule matches any string."""
    stop = [r for r in rules if r[0] == "blocking"]
    return F.exists(leaves, lambda x: suspicious(x["text"], stop))


def minor_hits(leaves: Column, rules=RULES, shown: int = 3) -> Column:
    """Names of the first minor rules that match, in order of strings and rules."""
    minor = [r for r in rules if r[0] == "minor"]
    return F.slice(F.flatten(F.transform(leaves, lambda x: F.transform(hits(x["path"], x["text"], minor), lambda h: h["rule"]))), 1, shown)


def repair_cases(schema: T.StructType, markers=MARKERS) -> dict[str, Column]:
    """The case columns of a record, attributed where they weren't."""
    return {
        name: F.col(name).withField("argument", text.attribute(F.col(name)["argument"], prefix, markers))
        for name, prefix in PREFIXES.items()
        if name in schema.fieldNames()
    }


def polish() -> dict[str, Column]:
    """Casing of reader-facing strings; restated labels off the bullets."""
    out = {c: text.fix_casing(F.col(c)) for c in ("headline", "hook", "what_happened", "market_reaction")}
    out["gist"] = F.transform("gist", lambda g: text.fix_casing(text.strip_gist_label(g)))
    return out | {c: F.col(c).withField("argument", text.fix_casing(F.col(c)["argument"])) for c in PREFIXES}


def enforce(rows: DataFrame, schema: T.StructType, rules=RULES, markers=MARKERS) -> DataFrame:
    """Records with blocked_by (null: cleared) and minor, repaired and polished.

    rows: a record's columns; violations (array of structs with severity) and rewrites (map by
    path) of a reviewer, null if there was none; and any other columns. Stops of the chain, in
    order: regex, reviewer, rewrite, unattributed, repair.
    """
    names = schema.fieldNames()
    others = [c for c in rows.columns if c not in names]
    look = lambda: blocked(json.leaves(schema), rules)
    reviewer = F.coalesce(F.exists("violations", lambda v: v["severity"] == "blocking"), F.lit(False))
    step = rows.withColumn("blocked_by", F.when(look(), "regex").when(reviewer, "reviewer"))
    mapped = F.coalesce("rewrites", F.create_map().cast("map<string,string>"))
    step = step.withColumn("rewrites", mapped).select(*json.rewrite(schema), *others, "blocked_by")
    step = step.withColumn("blocked_by", F.coalesce("blocked_by", F.when(look(), "rewrite")))
    step = step.withColumn("minor", minor_hits(json.leaves(schema), rules)).withColumns(repair_cases(schema, markers))
    cases = [c for c in PREFIXES if c in names]
    unattributed = F.lit(False)
    for c in cases:
        unattributed = unattributed | ~text.is_attributed(F.col(c)["argument"], markers)
    step = step.withColumn("blocked_by", F.coalesce("blocked_by", F.when(unattributed, "unattributed"), F.when(look(), "repair")))
    return step.withColumns({k: v for k, v in polish().items() if k in names})


#: Bounds of an analysis.
ANALYSIS = Record(
    {
        "headline": Text(most=140),
        "hook": Text(),
        "gist": Items(Text(), least=3, most=3),
        "what_happened": Text(),
        "who_is_affected": Items(Record({"group": Text(), "effect": Text()})),
        "sectors": Items(Record({"sector": Text(), "direction": Text(one_of=("tailwind", "headwind", "mixed", "neutral")), "why": Text()})),
        "transmission_mechanism": Record(
            {"chain": Items(Text(), least=2, most=6), "explanation": Text(), "time_horizon": Text(one_of=("days", "weeks", "months", "quarters"))}
        ),
        "market_reaction": Text(),
        "bull_case": Record({"argument": Text(), "depends_on": Items(Text(), optional=True)}),
        "bear_case": Record({"argument": Text(), "depends_on": Items(Text(), optional=True)}),
        "variables_to_watch": Items(Record({"variable": Text(), "why_it_matters": Text(), "when": Text()})),
        "confidence": Text(one_of=("high", "medium", "low")),
        "confidence_reason": Text(),
        "jargon": Items(Record({"term": Text(), "plain_meaning": Text()}), optional=True),
    }
)


def valid_analysis() -> Column:
    """Whether a parsed analysis keeps its bounds: lengths, numbers of items, closed vocabularies."""
    closed = lambda c, values: c.isin(*values)
    required = ["headline", "hook", "what_happened", "market_reaction", "confidence_reason"]
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    ok = ok & (F.length("headline") <= 140) & (F.size("gist") == 3) & F.forall("gist", lambda g: g.isNotNull())
    chain = F.col("transmission_mechanism")["chain"]
    ok = ok & F.size(chain).between(2, 6) & closed(F.col("transmission_mechanism")["time_horizon"], ["days", "weeks", "months", "quarters"])
    ok = ok & closed(F.col("confidence"), ["high", "medium", "low"])
    ok = ok & F.forall("sectors", lambda s: closed(s["direction"], ["tailwind", "headwind", "mixed", "neutral"]))
    ok = ok & F.col("bull_case")["argument"].isNotNull() & F.col("bear_case")["argument"].isNotNull()
    return F.coalesce(ok, F.lit(False))
