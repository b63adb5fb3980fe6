"""Tables and documents that runs write and the next run reads."""

from __future__ import annotations

import html
import json
import os
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom import schemas
from storyloom.operators import archive


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """JSON documents or lines under a schema; rows that aren't readable or lack what is required
    are left out, and a missing path is an empty table."""
    fs, p = _fs(spark, path)
    if not fs.globStatus(p):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", broken_ string").option("columnNameOfCorruptRecord", "broken_").option("multiLine", True).json(path)
    kept = rows.where(F.col("broken_").isNull())
    for c in required:
        kept = kept.where(F.col(c).isNotNull())
    return kept.drop("broken_")


def read_items(spark: SparkSession, site: str) -> DataFrame:
    return read_json(spark, f"{site}/api/v1/clusters/*.json", schemas.PUBLISHED, ["cluster_id", "published_at"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger table (Parquet folder) or document (JSON file)."""
    if path.endswith(".json"):
        return read_json(spark, path, schemas.LEDGER, ["date", "event_type", "entity", "cluster_id"])
    recover(spark, path)
    return spark.read.schema(schemas.LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], schemas.LEDGER)


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"can't rename {a} to {b}")


def recover(spark: SparkSession, path: str) -> None:
    """Ends a swap that was broken off: a missing table is the complete new one, else the old one."""
    base = path.rstrip("/")
    fs, p = _fs(spark, base)
    new, old, done = (_fs(spark, base + x)[1] for x in (".new", ".old", ".new/_SUCCESS"))
    if fs.exists(p):
        return
    if fs.exists(old) and fs.exists(done):
        _rename(fs, new, p)
    elif fs.exists(old):
        _rename(fs, old, p)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the path and swaps, so a table may be made from its own earlier state.

    At every moment the old table or the whole new one is there, under its name or where recover()
    finds it; a step that fails raises. One writer at a time. On stores whose renames copy, the swap
    takes as long as the copy, and stays safe.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    recover(spark, path)
    fs, p = _fs(spark, base)
    new, old = (_fs(spark, base + x)[1] for x in (".new", ".old"))
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(base + ".new")
    if fs.exists(p):
        if fs.exists(old) and not fs.delete(old, True):
            raise OSError(f"can't delete {old}")
        _rename(fs, p, old)
    _rename(fs, new, p)
    fs.delete(old, True)


def read_state(spark: SparkSession, path: str) -> dict:
    """What feeds told at the last run to ask them with: {source_id: {etag, last_modified}}, a row for each feed."""
    recover(spark, path)
    if not exists(spark, path):
        return {}
    return {r.source_id: {"etag": r.etag, "last_modified": r.last_modified} for r in spark.read.parquet(path).collect()}


def write_items(items: DataFrame, path: str) -> None:
    """A folder of JSON lines, partitioned by item."""
    items.withColumn("item", F.col("cluster_id")).write.mode("overwrite").partitionBy("item").json(path)


def write_dump(feeds: DataFrame, dumped: DataFrame, summary: DataFrame, folder: str) -> None:
    """Three documents to look into a run: each feed's status, each story in order of score, and
    one row of totals. Meant for one run's stories; larger tables belong in write_items()."""
    from storyloom.functions.json import rows_as_json

    os.makedirs(folder, exist_ok=True)
    status = feeds.select(F.col("source_id").alias("id"), "status", F.size("entries").alias("entries"), "error").orderBy("id")
    for name, rows in (("sources", status), ("clusters", dumped.orderBy(F.desc("score"), "id"))):
        with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
            f.write("[" + ",\n".join(r.j for r in rows_as_json(rows).toLocalIterator()) + "]\n")
    with open(f"{folder}/summary.json", "w", encoding="utf-8") as f:
        f.write(rows_as_json(summary).first().j + "\n")


PAGE = "<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>{title}</title><meta name=\"description\" content=\"{description}\"></head><body>{body}</body></html>\n"


def _page(title: str, body: str, description: str = "") -> str:
    return PAGE.format(title=html.escape(title), description=html.escape(description), body=body)


def write_site(items: DataFrame, as_of: F.Column, folder: str, disclaimer: str, limit: int = 10_000) -> int:
    """The whole site anew in a local folder: feed index, a document and a page per item, index,
    about and contact. Returns the number of items; refuses to replace a site by an empty one, or
    to write more than limit items from one machine."""
    n = items.count()
    if n == 0:
        return 0
    if n > limit:
        raise ValueError(f"{n} items are more than a site of pages holds ({limit})")
    import shutil

    shutil.rmtree(folder, ignore_errors=True)
    for d in ("story", "api/v1/clusters"):
        os.makedirs(f"{folder}/{d}")

    def put(name: str, content: str) -> None:
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(content)

    put("api/v1/feed.json", archive.feed_index(items, as_of, disclaimer).select(F.to_json(F.struct("*")).alias("j")).first().j)
    cards = archive.cards(items, as_of)
    rows = items.join(cards, "cluster_id").orderBy(F.desc("published_at"), "cluster_id")
    listing = []
    for r in rows.select("cluster_id", F.to_json(F.struct(*items.columns)).alias("doc"), "analysis.headline", "analysis.hook", "analysis.gist", "published_human",
                         "source_label", "description", "sources", cards["sectors"].alias("sectors"), cards["themes"].alias("themes")).toLocalIterator():
        put(f"api/v1/clusters/{r.cluster_id}.json", r.doc)
        chips = "".join(f"<span>{html.escape(x)}</span>" for x in [*(r.sectors or []), *(r.themes or [])])
        gist = "".join(f"<li>{html.escape(g)}</li>" for g in r.gist or [])
        links = "".join(f'<li><a href="{html.escape(s.url or "")}">{html.escape(s.headline or "")}</a> {html.escape(s.name or "")}</li>' for s in r.sources or [])
        put(f"story/{r.cluster_id}.html", _page(r.headline, f"<h1>{html.escape(r.headline)}</h1><ul>{gist}</ul><ul>{links}</ul><p>{html.escape(disclaimer)}</p>", r.description or ""))
        listing.append(f'<li><time>{r.published_human}</time><h2><a href="story/{r.cluster_id}.html">{html.escape(r.headline)}</a></h2><p>{html.escape(r.hook or "")}</p>{chips}<span>{r.source_label}</span></li>')
    put("index.html", _page("Stories", f"<ol>{''.join(listing)}</ol>"))
    put("about.html", _page("About", f"<p>{html.escape(disclaimer)}</p>"))
    put("contact.html", _page("Contact", "<p></p>"))
    put("robots.txt", "User-agent: *\nAllow: /\n")
    put(".nojekyll", "")
    return n


def publish(folder: str, remote: str, branch: str) -> bool:
    """Pushes a folder to a git branch as its only commit. False without an index page; a site
    without stories isn't pushed, so that the one before stays."""
    if not os.path.exists(f"{folder}/index.html"):
        return False
    if not any(n.endswith(".html") for n in os.listdir(f"{folder}/story")):
        return True
    with tempfile.TemporaryDirectory() as scratch:
        git = lambda *a: subprocess.run(["git", f"--git-dir={scratch}", f"--work-tree={folder}", *a], check=True, capture_output=True)
        try:
            subprocess.run(["git", "init", "-q", "--bare", scratch], check=True, capture_output=True)
            git("add", "-A", "--force", ".")
            git("-c", "user.name=publisher", "-c", "user.email=publisher@localhost", "commit", "-q", "-m", "Site")
            git("push", "-q", "--force", remote, f"HEAD:refs/heads/{branch}")
        except subprocess.CalledProcessError:
            return False
    return True


def holds_one_commit(remote: str, branch: str) -> bool:
    """Whether a published branch has no history; a branch that isn't there has none."""
    with tempfile.TemporaryDirectory() as scratch:
        run = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True)
        run("init", "-q", "--bare", scratch)
        if run(f"--git-dir={scratch}", "fetch", "-q", remote, f"refs/heads/{branch}").returncode:
            return True
        return int(run(f"--git-dir={scratch}", "rev-list", "--count", "FETCH_HEAD").stdout or 0) <= 1


def read_published(spark: SparkSession, remote: str, branch: str) -> DataFrame:
    """Items of a published branch, by a checkout on the driver."""
    with tempfile.TemporaryDirectory() as scratch:
        done = subprocess.run(["git", "clone", "-q", "--depth", "1", "--branch", branch, remote, scratch], capture_output=True)
        docs = []
        folder = f"{scratch}/api/v1/clusters"
        if done.returncode == 0 and os.path.isdir(folder):
            for name in sorted(os.listdir(folder)):
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    raw = f.read()
                try:
                    json.loads(raw)
                except ValueError:
                    continue
                docs.append((raw,))
        rows = spark.createDataFrame(docs, "raw string").select(F.from_json("raw", schemas.PUBLISHED).alias("r")).select("r.*")
        return rows.where(F.col("cluster_id").isNotNull() & F.col("published_at").isNotNull())


def load_previous(spark: SparkSession, site: str, as_of: F.Column, remote: str | None = None, branch: str = "site") -> DataFrame:
    """What is published and still fresh: of the site's folder, else of the published branch."""
    items = read_items(spark, site)
    if remote and items.isEmpty():
        items = read_published(spark, remote, branch)
    return archive.carry_forward(items, as_of)
