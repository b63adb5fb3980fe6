import hashlib
import random

from storyloom.llm import line_dedup as m

SCHEMA = "doc_id long, text string"
SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA + ", lines string, key string") if rows and len(rows[0]) > 2 else spark.createDataFrame(rows, SCHEMA)
    return [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in m.dedup_lines(docs.repartition(3), **options).collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_matches_plain_version_on_random_lines(spark):
    rng = random.Random(1)
    pool = ["x" * 39, "y" * 40, " Y" + "y" * 39, "É" + "a" * 40, "é" + "a" * 40, "", "   ", "short", "\t" + "z" * 50 + "\x0b", "Z" * 50 + "\xa0", "q" * 45]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 7)))) for k in range(60)]
    rows += [(None, "y" * 40 + "\nown"), (7, None), (8, ""), (3, "y" * 40), (3, "y" * 40), (59, "\n\n" + "y" * 40 + "\n")]
    assert order(run(spark, rows)) == order(plain(rows))
    assert order(run(spark, rows, min_chars=5, min_docs=2)) == order(plain(rows, 5, 2))


def test_hot_line_and_long_text(spark):
    hot = "a line that a third of all documents hold, word for word"
    rows = [(k, f"{hot}\nown {k}") for k in range(300)] + [(1000, "\n".join([hot] * 5000 + ["end"]))]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[1000][3] == 0 and all(got[k] == (k, f"own {k}", 2, 1) for k in range(300))


def test_all_lines_dropped_and_clashing_columns(spark):
    line = "w" * 41
    rows = [(k, f"{line}\n{line}", "gone", "h1") for k in range(6)]
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert got[0] == ("", 2, 2) and got[5] == (f"{line}\n{line}", 2, 0)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query_hashes_what_stays(spark, tmp_path):
    line = "v" * 44
    rows = [(k, f"{line}\n{k}") for k in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in m.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256((f"{line}\n4" if k == 4 else str(k)).encode()).hexdigest() for k in range(5)}
