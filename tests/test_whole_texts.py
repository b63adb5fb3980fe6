"""Queries that read whole texts, against plain Python."""

import re

import pytest

from storyloom.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    pad = "word " * 40
    turns = [(1, 0, "short"), (1, 1, pad + "the that end"), (1, 2, pad + "with"), (1, 3, pad + "from"), (1, 4, "nothing"), (1, 5, pad + "The  that"), (1, 6, pad + "In the end"),
             (2, 0, "a"), (2, 1, None), (2, 2, pad + "with"), (2, 3, pad + "from"), (2, 7, pad + "of the"), (4, 0, "x")]
    docs = [(7, pad + "portion and of the that", "en"), (8, None, "en"), (9, "plain", "fr"), (12, pad + "NASA AI api", "en")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path, turns, docs


def test_every_turn_is_a_leaf_with_its_whole_text(spark, tables):
    path, turns, _ = tables
    got = sorted((r.conv_id, r.text) for r in catalogue.flatten_leaves(spark, path).collect() if r.text != "none")
    assert got == sorted((c, t) for c, _, t in turns if t is not None)


def test_scan_reads_all_turns_and_documents(spark, tables):
    path, turns, docs = tables
    got = sorted((r.source, r.id, r.rule, r.quote) for r in catalogue.compliance_scan(spark, path).collect())
    texts = [("conversations", c, t) for c, _, t in turns] + [("documents", d, t) for d, t, _ in docs]
    want = [(s, k, rule, m[0]) for s, k, t in texts for _, p, rule in catalogue.RULES if t and (m := re.search("(?i)" + p, t))]
    assert got == sorted(want) and len(got) == 6 and ("conversations", 2, "third rule", "of the") in got


def test_chain_blocks_by_what_stands_late(spark, tables):
    got = {r.conv_id: r.blocked_by for r in catalogue.enforce_pipeline(spark, tables[0]).collect()}
    assert got == {1: "regex", 2: None, 4: "unattributed"}


def test_casing_is_repaired_to_the_end(spark, tables):
    path, _, docs = tables
    got = {r.doc_id: r for r in catalogue.casing_repair(spark, path).collect()}
    late = next(t for k, t, _ in docs if k == 12).lower()
    assert set(got) == {7, 8, 12} and got[8].fixed is None
    assert got[12].fixed == "The AI and API of " + late.replace(" ai api", " AI API")
    assert got[12].bullet == "the ai and api of " + late
