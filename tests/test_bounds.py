import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.functions.bounds import Items, Record, Text, complaint, first_problem, problem_of
from storyloom.operators.compliance import ANALYSIS

SPEC = Record(
    {
        "a": Text(most=3),
        "b": Items(Record({"c": Text(one_of=("x", "y")), "d": Items(Items(Text(most=1)), least=1, optional=True)}), least=1, most=2),
        "odd name": Text(optional=True),
    }
)
GOOD = {
    "headline": "h" * 140, "hook": "", "gist": ["1", "2", "3"], "what_happened": "w", "who_is_affected": [], "sectors": [{"sector": "s", "direction": "mixed", "why": ""}],
    "transmission_mechanism": {"chain": ["a", "b"], "explanation": "", "time_horizon": "days"}, "market_reaction": "", "bull_case": {"argument": "a"},
    "bear_case": {"argument": "a", "depends_on": ["x"]}, "variables_to_watch": [], "confidence": "low", "confidence_reason": "", "extra": 1,
}
CASES = [
    ({}, None), ({"headline": "é" * 141}, "headline has 141 characters, at most 140 may be"), ({"gist": ["a"]}, "gist has 1 items, at least 3 must be"),
    ({"gist": ["a", "b", "c", "d"]}, "gist has 4 items, at most 3 may be"), ({"gist": ["a", 2, "c"]}, "gist[1] must be text"), ({"hook": None}, "hook must be text"),
    ({"sectors": [GOOD["sectors"][0], {"sector": "s", "direction": "up", "why": ""}]}, "sectors[1].direction must be one of: tailwind, headwind, mixed, neutral"),
    ({"bull_case": "b"}, "bull_case must be an object"), ({"bear_case": {}}, "bear_case.argument is missing"), ({"jargon": {}}, "jargon must be a list"),
    ({"transmission_mechanism": {"chain": ["a"], "explanation": 1}}, "transmission_mechanism.chain has 1 items, at least 2 must be"), ({"confidence": "sure"}, "confidence must be one of: high, medium, low"),
]


def columns(spark, spec, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    found = rows.select("k", first_problem(spec, F.try_parse_json("t")).alias("p")).orderBy("k").collect()
    return [r.p and tuple(r.p) for r in found]


def test_an_analysis(spark):
    values = [GOOD | change for change, _ in CASES]
    assert [complaint(ANALYSIS, v) for v in values] == [want for _, want in CASES]
    missing = {k: v for k, v in GOOD.items() if k != "sectors"}
    texts = [json.dumps(v) for v in [*values, missing]] + ["[1]", "3", "no json", None]
    want = [problem_of(ANALYSIS, v) for v in [*values, missing, [1], 3]] + [("", "is missing")] * 2
    assert columns(spark, ANALYSIS, texts) == want


LEAF = st.one_of(st.none(), st.integers(-5, 5), st.booleans(), st.sampled_from(["", "x", "y", "xyzw", "日本語x"]))
INNER = st.one_of(LEAF, st.lists(st.one_of(LEAF, st.lists(LEAF, max_size=2)), max_size=3))
VALUE = st.fixed_dictionaries(
    {}, optional={"a": LEAF, "b": st.one_of(LEAF, st.lists(st.one_of(LEAF, st.fixed_dictionaries({}, optional={"c": LEAF, "d": INNER})), max_size=3)), "odd name": LEAF, "z": LEAF}
)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(VALUE, LEAF, st.lists(LEAF, max_size=2)), min_size=150, max_size=200))
def test_both_say_the_same(spark, values):
    assert columns(spark, SPEC, [json.dumps(v) for v in values]) == [problem_of(SPEC, v) for v in values]


@pytest.mark.parametrize("n", [1, 3])
def test_very_long_texts(spark, n):
    text = "x" * 3_000_000
    assert columns(spark, Record({"a": Text(most=n)}), [json.dumps({"a": text})]) == [("a", f"has 3000000 characters, at most {n} may be")]
