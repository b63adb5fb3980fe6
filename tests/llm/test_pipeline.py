import os

import pytest

import corpus_pipeline
from storyloom.llm.decontaminate import folded_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    import random

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    good = lambda n: " ".join(word() for _ in range(n)) + "."
    item = good(40)
    line = good(12)
    docs = [[k, "\n".join(good(30) for _ in range(4))] for k in range(160)]
    for k in range(100, 140):  # rejected
        docs[k][1] = " ".join(word().upper() + "!!" for _ in range(90))
    for k in range(0, 8):  # a line that repeats
        docs[k][1] += "\n" + line
    docs[20][1] = docs[21][1]  # exact copies
    docs[31][1] = docs[30][1] + " more"  # a near copy
    docs[40][1] = "Some words before. " + item.upper()  # contaminated
    docs += [[160, None], [161, ""]]
    path = str(tmp_path_factory.mktemp("planted"))
    rows = [(k, t, "en", f"s{k}", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS text_hash", "2 AS r_id").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(not 100 <= k < 140), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {k: t for k, t in docs}, line


def test_stages_take_out_what_is_planted_and_nothing_else(spark, planted):
    path, texts, line = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    kept = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    clean = set(range(162)) - set(range(100, 140))
    assert kept["quality"] - {160, 161} == clean - {160, 161}
    assert kept["line_dedup"] == kept["quality"]
    after = {r.doc_id: r for r in seen["line_dedup"]}
    assert all(line not in (after[k].text or "") for k in range(7)) and line in after[7].text
    assert after[3].text == texts[3][: -len(line) - 1] and after[3].n_chars == len(after[3].text)
    assert all(after[k].text == texts[k] for k in range(8, 100))
    lost = kept["line_dedup"] - kept["near_duplicates"]
    assert 21 in lost and 20 in kept["near_duplicates"] and lost <= {21, 31, 160, 161}
    assert kept["near_duplicates"] - kept["decontamination"] == {40}
    assert kept["packing"] == kept["decontamination"] and folded_words(texts[40])


def test_run_and_an_empty_corpus(spark, planted, tmp_path):
    path, _, _ = planted
    got = corpus_pipeline.run(spark, path)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert os.path.exists(path)


def test_odd_rows_run_through_every_stage(spark, planted, tmp_path):
    """Null ids, texts and other columns, repeated rows, ties, and a very long text."""
    path, texts, _ = planted
    long = " ".join(f"w{k}" for k in range(150_000))
    odd = [(None, "A text of a row without an id, and some more words.", None, None, None), (None, None, None, None, None), (500, None, None, None, 0),
           (501, "", "en", None, 0), (502, long, None, "s", 1), (503, texts[50], "en", "s", 1), (503, texts[50], "en", "s", 1), (504, texts[51], "en", "s", 1),
           (504, " ".join(reversed(texts[52].split())), "en", "s", 1)]
    rows = [(k, t, "en", f"s{k}", len(t or "")) for k, t in texts.items()] + odd
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    # What the classifier makes of odd texts is its own affair: the others get all rows.
    judged = corpus_pipeline.STAGES[0][1](spark, docs, path)
    assert judged.columns == corpus_pipeline.COLUMNS and {50, 503} <= {r.doc_id for r in judged.collect()}
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), name)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert None in kept and {50, 502} <= kept, name
    pieces = docs.where("doc_id = 502").collect()
    assert sum(r.length for r in pieces) > 150_000 and len({r.piece for r in pieces}) == len(pieces)
    assert docs.where("doc_id = 503").count() == 0  # copies of 50, the smallest id
    assert docs.where("doc_id = 504 and piece = 0").count() == 1  # its text that is no copy of 51


def test_a_corpus_without_labels_keeps_what_the_classifier_would_judge(spark, planted, tmp_path):
    path, texts, _ = planted
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count() == len(texts)
