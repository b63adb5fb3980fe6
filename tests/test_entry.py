import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["articles_base", "canonical_url_id", "jaccard_pairs", "score_breakdown", "archive_merge", "compliance_scan", "ledger_record", "op3_line_dedup", "op10_decontaminate"]


def value(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(value, v)) if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in QUICK if n in entry.queries()])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr) == want and sorted(names) == cols


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The rest imports and lists its queries where the folders of the corpus operators are gone."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; n = set(e.queries()); "
        "assert 'score_breakdown' in n and 'pipeline' not in n and not any(x.startswith('op') for x in n), n; assert set(e.oracle_sql()) <= n"
    )
    for name in ("__spark_entry__.py", "storyloom"):
        src, dst = f"{repo}/{name}", tmp_path / name
        if os.path.isdir(src):
            import shutil

            shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            dst.write_text(open(src).read())
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, cwd=tmp_path)
