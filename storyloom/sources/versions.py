"""A table of keyed rows that a stream changes: data in folders of their own, and a log that makes them visible.

A change writes the rows that are new or other than before, and the keys that go, to a folder with a random name.
Then one small file in ``log``, written beside and renamed, commits it. Readers take what the log names, the
latest row of each key, so a batch that is broken off before its commit leaves nothing that anyone reads, and
one that is run again after it (the log knows the stream's batch) does nothing. Every ``compact`` changes a
whole state is written instead; what it replaces is kept until the next one, for readers that have begun.

One writer at a time. A log file that isn't whole can't come about where a rename is one step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.sources.stored import _fs, _rename


def log(spark: SparkSession, table: str) -> list[dict]:
    """The committed changes in order, from the last whole state on: sequence, stream, batch, path, whole."""
    fs, p = _fs(spark, f"{table}/log")
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
    if not names:
        return []
    rows = spark.read.schema("sequence long, stream string, batch long, path string, whole boolean").json([f"{table}/log/{n}" for n in names])
    found = [r.asDict() for r in rows.orderBy("sequence").collect()]  # few: whole states end the list
    start = max((k for k, r in enumerate(found) if r["whole"]), default=0)
    return found[start:]


def commit(spark: SparkSession, table: str, entry: dict) -> None:
    """Makes a change visible."""
    name = f"{table}/log/{entry['sequence']:012}.json"
    fs, final = _fs(spark, name)
    _, beside = _fs(spark, f"{name}.{uuid.uuid4().hex}")
    if fs.exists(final):
        raise OSError(f"{name} is committed: there is another writer")
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    _rename(fs, beside, final)


def read(spark: SparkSession, table: str, key: str, entries: list[dict] | None = None) -> DataFrame | None:
    """The latest row of each key; None before the first commit."""
    entries = log(spark, table) if entries is None else entries
    if not entries:
        return None
    rows = spark.read.parquet(*(e["path"] for e in entries))
    rest = [c for c in rows.columns if c not in (key, "sequence_", "gone_")]
    last = rows.groupBy(key).agg(F.max_by(F.struct("gone_", *rest), "sequence_").alias("s"))
    return last.where(~F.col("s.gone_")).select(key, *(F.col("s")[c].alias(c) for c in rest))


def committed(entries: list[dict], stream: str, batch: int) -> bool:
    return any(e["stream"] == stream and e["batch"] >= batch for e in entries)


def change(spark: SparkSession, table: str, key: str, entries: list[dict], stream: str, batch: int, rows: DataFrame, gone: DataFrame, compact: int = 20) -> None:
    """Commits rows as they are now and the keys (gone) that are no more; with every ``compact``-th change, the whole state."""
    sequence = entries[-1]["sequence"] + 1 if entries else 0
    marked = lambda d, lost: d.withColumn("sequence_", F.lit(sequence).cast("long")).withColumn("gone_", F.lit(lost))
    delta = marked(rows, False).unionByName(marked(gone.select(key), True), allowMissingColumns=True)
    path = f"{table}/data/{uuid.uuid4().hex}"
    delta.write.parquet(path)
    whole = len(entries) >= compact
    if whole:
        state = read(spark, table, key, [*entries, {"path": path}])
        path = f"{table}/data/{uuid.uuid4().hex}"
        marked(state, False).write.parquet(path)
    commit(spark, table, {"sequence": sequence, "stream": stream, "batch": batch, "path": path, "whole": whole or not entries})
    if whole:
        _forget(spark, table, entries[0]["sequence"])


def _forget(spark: SparkSession, table: str, before: int) -> None:
    """Deletes what was committed before the whole state of that number, and its log."""
    fs, p = _fs(spark, f"{table}/log")
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.endswith(".json") and int(name[:12]) < before:
            path = spark.read.json(f"{table}/log/{name}").first().path
            fs.delete(_fs(spark, path)[1], True)
            fs.delete(s.getPath(), False)
