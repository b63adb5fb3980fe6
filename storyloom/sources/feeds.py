"""Feeds as a Spark data source: one partition per feed, one row per feed, failures as rows.

    spark.dataSource.register(FeedSource)
    spark.read.format("feeds").option("sources", json).option("state", json).load()

sources is a JSON list of {id, url, timeout_seconds}; state, a JSON object by id of the etag and
last_modified that an earlier read returned, makes requests conditional. Landed files are read by
read_landed().
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib import error, request
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("title", "link", "summary", "description", "published", "updated", "created", "date", "dc_date")
SCHEMA = "source_id string, status int, error string, etag string, last_modified string, entries array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"
AGENT = "storyloom/1.0"
RETRY_SECONDS = 1.5

#: Element names (without namespace) of RSS and Atom by the field they fill; the first found counts.
NAMES = {
    "title": ["title"], "link": ["link"], "summary": ["summary", "description"], "description": ["description", "summary", "content"],
    "published": ["pubDate", "published", "issued"], "updated": ["updated", "modified", "lastBuildDate"], "created": ["created"], "date": ["date"], "dc_date": ["date"],
}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_feed(raw: bytes) -> list[tuple] | None:
    """Entries of an RSS, RDF or Atom document in its order, or None if it is not XML."""
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None
    out = []
    for item in (e for e in root.iter() if _local(e.tag) in ("item", "entry")):
        children: dict[str, list] = {}
        for c in item:
            children.setdefault(_local(c.tag), []).append(c)
        row = []
        for field in FIELDS:
            found = next((c for n in NAMES[field] for c in children.get(n, [])), None)
            if field == "link":
                links = children.get("link", [])
                found = next((c for c in links if c.get("rel", "alternate") == "alternate"), links[0] if links else None)
                value = None if found is None else found.get("href") or (found.text or "").strip() or None
            else:
                value = None if found is None else "".join(found.itertext()).strip() or None
            row.append(value)
        out.append(tuple(row))
    return out


def http_get(url: str, headers: dict, timeout: float) -> tuple[int, dict, bytes]:
    """(status, headers, body); statuses of refusal are answers, faults of transport raise."""
    try:
        with request.urlopen(request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


def fetch_one(source: dict, state: dict | None = None, get: Callable = http_get, wait: Callable = time.sleep) -> tuple:
    """A row of SCHEMA. Faults of transport are tried once more; other statuses than 200 and 304
    are errors and aren't. An unchanged feed (304) has no entries and no error."""
    known = (state or {}).get(source["id"]) or {}
    headers = {"User-Agent": AGENT}
    if known.get("etag"):
        headers["If-None-Match"] = known["etag"]
    if known.get("last_modified"):
        headers["If-Modified-Since"] = known["last_modified"]
    row = lambda status=None, err=None, e=known.get("etag"), m=known.get("last_modified"), entries=(): (source["id"], status, err, e, m, list(entries))
    for attempt in (1, 2):
        try:
            status, got, body = get(source["url"], headers, source.get("timeout_seconds") or 20)
            break
        except (OSError, TimeoutError) as e:
            if attempt == 1:
                wait(RETRY_SECONDS)
                continue
            return row(err=f"{type(e).__name__}: {e}")
        except Exception as e:  # noqa: BLE001 - one bad feed is one bad row
            return row(err=f"{type(e).__name__}: {e}")
    if status == 304:
        return row(304)
    if status != 200:
        return row(status, f"HTTP {status}")
    entries = parse_feed(body)
    if entries is None:
        return row(200, "unparseable feed")
    return row(200, None, got.get("etag"), got.get("last-modified"), entries)


class FeedReader(DataSourceReader):
    def __init__(self, sources: list[dict], state: dict) -> None:
        self.sources, self.state = sources, state

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.sources))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield fetch_one(self.sources[partition.value], self.state)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(json.loads(self.options["sources"]), json.loads(self.options.get("state", "{}")))


def next_state(feeds: DataFrame) -> DataFrame:
    """(source_id, etag, last_modified) to hand to the next read."""
    return feeds.where(F.col("etag").isNotNull() | F.col("last_modified").isNotNull()).select("source_id", "etag", "last_modified")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Feed documents that lie in files named after their source, as rows of SCHEMA."""

    def parse(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(f, pa.string()) for f in FIELDS]))
        for b in batches:
            found = [parse_feed(x.as_py()) for x in b.column("content")]
            err = [None if f is not None else "unparseable feed" for f in found]
            none = pa.nulls(len(found), pa.string())
            entries = pa.array([[dict(zip(FIELDS, e, strict=True)) for e in f or []] for f in found], kind)
            yield pa.RecordBatch.from_arrays(
                [b.column("source_id"), pa.array([200] * len(found), pa.int32()), pa.array(err, pa.string()), none, none, entries],
                ["source_id", "status", "error", "etag", "last_modified", "entries"],
            )

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("source_id"), "content").mapInArrow(parse, SCHEMA)
