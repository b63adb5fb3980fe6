import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom.operators import archive
from storyloom.sources import versions
from storyloom.streaming import arrivals

T0 = datetime(2026, 8, 11, 12)
NOW = F.lit("2026-08-11 12:00:00").cast("timestamp")
ITEM = "cluster_id string, sources array<struct<name:string,url:string>>, published_at timestamp, updated_at timestamp"


def item(c, url, minutes, hours=0):
    return (c, [("n", url)], T0 - timedelta(hours=hours), T0 + timedelta(minutes=minutes))


BATCHES = [
    [item("a", "u1", 0), item("b", "u2", 0), item("old", "u9", 0, 30), item("d", "u4", 0)],
    [item("c", "u1", 5)],
    [item("b", "u3", 7), item("e", "u4", -1)],
    [item("f", "u3", 1), item("g", "u5", 2)],
]


def expected(spark, n):
    rows = spark.createDataFrame([], ITEM)
    for b in BATCHES[:n]:
        rows = archive.merge(spark.createDataFrame(b, ITEM), archive.carry_forward(rows, NOW))
    return sorted((r.cluster_id, r.updated_at) for r in archive.carry_forward(rows, NOW).collect())


def got(spark, table):
    return sorted((r.cluster_id, r.updated_at) for r in arrivals.read_published(spark, table, NOW).collect())


def test_batches_are_committed_once_and_survive_a_crash(spark, tmp_path, monkeypatch):
    table, check = f"{tmp_path}/items", f"{tmp_path}/check"

    def run(k):
        spark.createDataFrame(BATCHES[k], ITEM).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        return again()

    def again():
        q = arrivals.publish_changes(spark.readStream.schema(ITEM).parquet(f"{tmp_path}/in/*"), table, check, NOW)
        q.awaitTermination(120)
        return q

    run(0)
    assert got(spark, table) == expected(spark, 1)
    # Killed between writing and committing: what is written isn't seen, and the batch is run again.
    commit = versions.commit

    def killed(*args):
        raise OSError("killed")

    monkeypatch.setattr(versions, "commit", killed)
    with pytest.raises(Exception):  # noqa: B017, PT011
        run(1)
    monkeypatch.setattr(versions, "commit", commit)
    folders = len(os.listdir(f"{table}/data"))
    assert got(spark, table) == expected(spark, 1) and folders == 2
    again()
    assert got(spark, table) == expected(spark, 2) and len(versions.log(spark, table)) == 2
    run(2)
    assert got(spark, table) == expected(spark, 3)
    # A batch that was committed, but whose stream didn't learn of it, changes nothing.
    before = versions.log(spark, table)
    arrivals.change_items(spark.createDataFrame([item("z", "u7", 0)], ITEM), before[-1]["batch"], table, check, NOW)
    assert versions.log(spark, table) == before and got(spark, table) == expected(spark, 3)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    table = f"{tmp_path}/items"
    many = [item(f"m{k:04}", f"v{k}", 0) for k in range(500)]
    arrivals.change_items(spark.createDataFrame(many, ITEM), 0, table, "s", NOW)
    arrivals.change_items(spark.createDataFrame([item("new", "v7", 3), item("m0009", "v9", 4)], ITEM), 1, table, "s", NOW)
    entries = versions.log(spark, table)
    assert [spark.read.parquet(e["path"]).count() for e in entries] == [500, 3]  # two items and the id of one that goes
    assert len(got(spark, table)) == 500


def test_whole_states_replace_changes(spark, tmp_path):
    table = f"{tmp_path}/items"
    for n, b in enumerate(BATCHES):
        arrivals.change_items(spark.createDataFrame(b, ITEM), n, table, "s", NOW, compact=2)
        assert got(spark, table) == expected(spark, n + 1)
    for n in range(4, 9):
        arrivals.change_items(spark.createDataFrame([item(f"x{n}", f"x{n}", n)], ITEM), n, table, "s", NOW, compact=2)
    entries = versions.log(spark, table)
    assert entries[0]["whole"] and len(entries) <= 3 and len(os.listdir(f"{table}/log")) < 20
    assert [c for c, _ in got(spark, table)] == sorted([c for c, _ in expected(spark, 4)] + [f"x{n}" for n in range(4, 9)])
    # Another writer's commit isn't overwritten.
    with pytest.raises(OSError, match="another writer"):
        versions.commit(spark, table, entries[-1])


def test_no_table_yet(spark, tmp_path):
    assert arrivals.read_published(spark, f"{tmp_path}/none", NOW) is None and versions.log(spark, f"{tmp_path}/none") == []
