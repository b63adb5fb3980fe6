"""WARC archives and a globally ordered capture index by external k-way merging.

1. ``decide``: of captures with equal payloads (SHA-256) of at least ``min_bytes``, the one
   with the smallest id is a response and the others revisit it. Only ids and digests are
   shuffled for this, with partial aggregation.
2. ``write_archives``: every task appends its records, each a gzip member, to archive files in
   the shared folder. A file's name holds a random part, and only names in the written
   manifest count, so files of failed or repeated tasks are never read.
3. ``index_archives``: every archive is read back from start to end; payloads are digested
   again, and each task writes the captures of its archives, sorted by (URL key, timestamp, id), as runs
   of ``run_captures`` with a sparse table of keys and byte offsets. Small archives share a task.
4. ``merge_runs``: a loser tree merges the runs, ``fan_in`` at once, in as many passes as that takes.
   In every pass, the last one and those before, each group of runs is cut into key ranges of about
   ``range_captures``, whose bounds come from the sparse tables, and every task merges one range of
   its group, seeking past what lies before it: no task reads more than its range and the rows between
   two marks of each run, however long the runs have become. A pass before the last writes a file for
   each range; these together are the longer run. A bound is a whole (key, timestamp, id), so the
   captures of one host or URL may be split between tasks. Ranges in order are the capture histories
   in global order. Open files and memory are bounded by fan_in.

Files are written and read through pyarrow.fs, for which the shared folder's address must be
one that it knows (file, hdfs, s3, gs).

Defined results: a null payload is empty, a null URL has the empty key. Rows that repeat an id
and payload are all responses where that id is the smallest. A null id is larger than any
other: such a row revisits a row with an id, and is a response if there is none. Captures
without timestamps get one that counts seconds from ``epoch``, by the id modulo 4 * 10**9 (or by the
CRC-32 of a string id). Timestamps are kept within the years 1 to 9999; a null one is the epoch of
1970. Ids are integers or strings. Only the named columns are read, and an empty table gives an empty
index.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.shared import materialize, new_path

#: Ids stand for seconds modulo this.
ID_SECONDS = 4_000_000_000
#: The first second of year 1 and the last of year 9999, as dates of records have four digits for it.
FIRST, LAST = -62_135_596_800, 253_402_300_799
VERSION = b"WARC/1.1"
END = b"\r\n"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, lower-cased, without scheme, user, default port,
    leading www and fragment: URLs of one host and of its subdomains sort together."""
    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^#]*)", url or "")
    if not m:
        return (url or "").partition("#")[0].lower()
    host = re.sub(r"^www\d*\.", "", m[1].rpartition("@")[2].lower())
    host, _, port = host.partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (m[2] or "/").lower()


def file_system(uri: str):
    """pyarrow's file system for an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(row: dict, date: str) -> bytes:
    """One WARC record, uncompressed."""
    payload = row["payload"] or b""
    from urllib.parse import quote

    revisit = row["refers_to"] is not None
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(row["url"] or "urn:none", safe="".join(map(chr, range(33, 127)))),
        "X-Target-URI": json.dumps(row["url"]),
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
        "X-Capture-ID": json.dumps(row["id"]),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Capture-ID"] = json.dumps(row["refers_to"])
    head["Content-Type"] = "application/http; msgtype=response"
    head["Content-Length"] = str(len(block))
    lines = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in head.items())
    return VERSION + END + lines + END + block + END + END


def read_records(stream, chunk: int = 1 << 20):
    """(offset, length, headers, block) of each gzip member of an archive, read piece by piece."""
    import zlib

    buffer, at, offset = b"", 0, 0
    while True:
        if at >= len(buffer):
            buffer, at = stream.read(chunk), 0
            if not buffer:
                return
        d, parts, used = zlib.decompressobj(31), [], 0
        while not d.eof:
            if at >= len(buffer):
                buffer, at = stream.read(chunk), 0
                if not buffer:
                    raise ValueError("archive ends within a record")
            view = buffer[at:] if at else buffer
            parts.append(d.decompress(view))
            taken = len(view) - len(d.unused_data)
            at, used = at + taken, used + taken
        raw = b"".join(parts)
        head, _, rest = raw.partition(END + END)
        headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        yield offset, used, headers, rest[: int(headers["Content-Length"])]
        offset += used


def decide(pages: DataFrame, id_col: str, url_col: str, payload_col: str, time_col: str | None, min_bytes: int) -> DataFrame:
    """id, url, payload, seconds, digest and refers_to of each row."""
    text = dict(pages.dtypes)[id_col] == "string"
    own = F.crc32(F.col(id_col)) if text else F.pmod(F.col(id_col).cast("long"), F.lit(ID_SECONDS))
    base = pages.select(
        F.col(id_col).cast("string" if text else "long").alias("id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
        (F.unix_seconds(F.col(time_col).cast("timestamp")) if time_col else own).alias("seconds"),
    ).withColumn("digest", F.sha2("payload", 256))
    light = base.where(F.octet_length("payload") >= min_bytes).select("id", "digest")
    first = light.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = first.where((F.col("n") > 1) & F.col("refers_to").isNotNull()).select("digest", "refers_to")
    revisits = materialize(
        light.join(materialize(first, "repeated"), "digest")
        .where(~F.col("id").eqNullSafe(F.col("refers_to")))
        .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
        .distinct(),
        "revisits",
    )
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    return base.join(revisits, same, "left").drop("r_id", "r_digest")


def iso(seconds: int | None) -> str:
    from datetime import UTC, datetime, timedelta

    at = min(max(seconds or 0, FIRST), LAST)
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=at)).replace(tzinfo=None).isoformat() + "Z"


def archive_writer(uri: str, epoch: int, roll_bytes: int, level: int):
    def run(batches):
        import gzip

        import pyarrow as pa

        fs, root = file_system(uri)
        name, out, size, records = "", None, 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"]
            )

        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("id", "url", "payload", "seconds", "digest", "refers_to")}
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                seconds = (row["seconds"] or 0) + epoch
                out.write(gzip.compress(record(row, iso(seconds)), level, mtime=0))
                size = out.tell()
                records += 1
                if size >= roll_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write_archives(decided: DataFrame, uri: str, *, epoch: int = 0, roll_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Writes the archives; the manifest (archive, records, bytes) is a written table."""
    fs, root = file_system(uri)
    fs.create_dir(root, recursive=True)
    run = archive_writer(uri, epoch, roll_bytes, level)
    return materialize(decided.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def capture(archive: str, offset: int, length: int, headers: dict, block: bytes) -> tuple:
    """(key, time, id or None, rest) of a record; the payload is digested again where it is held."""
    import hashlib

    digest, n = headers["WARC-Payload-Digest"].partition(":")[2], int(headers["X-Payload-Length"])
    kind, refers = headers["WARC-Type"], json.loads(headers.get("X-Refers-To-Capture-ID", "null"))
    if kind == "response":
        payload = block.partition(END + END)[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != n:
            raise ValueError(f"{archive} at {offset}: the payload isn't what was written")
    url = json.loads(headers["X-Target-URI"])
    return url_key(url), headers["WARC-Date"], json.loads(headers["X-Capture-ID"]), [url, kind, digest, n, refers, archive, offset, length]


def order(c) -> tuple:
    """Sort key of a capture; null ids come last."""
    return c[0], c[1], c[2] is None, 0 if c[2] is None else c[2]


class RunWriter:
    """Writes captures in order as lines, and keeps each ``every``-th one's key and offset and the last key.

    A file never has more than MARKS of these: beyond, every other one is dropped.
    """

    MARKS = 512

    def __init__(self, fs, path: str, every: int) -> None:
        self.out, self.every, self.n, self.marks = fs.open_output_stream(path), every, 0, []
        self.size, self.lines, self.last = 0, [], None

    def add(self, c) -> None:
        line = json.dumps(c, ensure_ascii=True).encode() + b"\n"
        if self.n % self.every == 0:
            if len(self.marks) == self.MARKS:
                self.marks, self.every = self.marks[::2], self.every * 2
            if self.n % self.every == 0:
                self.marks.append([list(c[:3]), self.size])
        self.n += 1
        self.size += len(line)
        self.last = list(c[:3])
        self.lines.append(line)
        if len(self.lines) >= 512:
            self.out.write(b"".join(self.lines))
            self.lines = []

    def close(self) -> dict:
        self.out.write(b"".join(self.lines))
        self.out.close()
        return {"marks": self.marks, "last": self.last}


def file_row(run: str, name: str, writer: RunWriter):
    import pyarrow as pa

    marks = json.dumps(writer.close())
    return pa.RecordBatch.from_arrays(
        [pa.array([run]), pa.array([name]), pa.array([writer.n], pa.int64()), pa.array([marks])], ["run", "file", "captures", "marks"]
    )


#: A run is one file, or several with a key range each.
RUN = "run string, file string, captures long, marks string"


def archive_indexer(uri: str, run_captures: int, every: int):
    def run(batches):
        fs, root = file_system(uri)
        held: list[tuple] = []

        def sorted_run():
            held.sort(key=order)
            name = f"{uuid.uuid4().hex}.run"
            w = RunWriter(fs, f"{root}/{name}", every)
            for c in held:
                w.add(c)
            held.clear()
            return file_row(name, name, w)

        for b in batches:
            for name in b.column("archive").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for found in read_records(stream):
                        held.append(capture(name, *found))
                        if len(held) >= run_captures:
                            yield sorted_run()
        if held:
            yield sorted_run()

    return run


def index_archives(manifest: DataFrame, uri: str, *, run_captures: int = 200_000, every: int = 512) -> DataFrame:
    """Reads every archive back and writes sorted capture runs; the runs are a written table."""
    found = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum("records").alias("records")).first()
    # As many tasks as there are runs to write, but enough of them for the cluster's cores.
    full = -(-(found.records or 0) // run_captures)
    n = max(1, min(found.n, max(full, 4 * manifest.sparkSession.sparkContext.defaultParallelism)))
    spread = manifest.select("archive").repartitionByRange(n, "archive")
    return materialize(spread.mapInArrow(archive_indexer(uri, run_captures, every), RUN), "runs")


def read_run(fs, path: str, offset: int, low, high):
    """Captures of a run from low (or from its start) up to high (or to its end)."""
    with fs.open_input_file(path) as f:
        f.seek(offset)
        left = b""
        while chunk := f.read(1 << 16):
            lines = (left + chunk).split(b"\n")
            left = lines.pop()
            for line in lines:
                c = json.loads(line)
                k = order(c)
                if high is not None and k >= high:
                    return
                if low is None or k >= low:
                    yield k, c


class LoserTree:
    """k-way merge of sorted iterators of (key, value): one comparison per level for each output."""

    def __init__(self, sources) -> None:
        self.sources = [iter(s) for s in sources]
        self.k = len(self.sources)
        self.head = [next(s, None) for s in self.sources]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _play(self, i: int) -> None:
        """Leaf i plays upwards from its parent; losers stay and the winner is kept at node 0."""
        at = (i + self.k) // 2
        while at:
            other = self.losers[at]
            if other < 0:  # as the tree is built, the first to come waits
                self.losers[at] = i
                return
            if self._beats(other, i):
                self.losers[at], i = i, other
            at //= 2
        self.losers[0] = i

    def __iter__(self):
        if not self.k:
            return
        while (top := self.head[w := self.losers[0]]) is not None:
            yield top
            self.head[w] = next(self.sources[w], None)
            self._play(w)


HISTORY = (
    "part int, seq long, url_key string, timestamp string, id {id}, url string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to {id}, archive string, offset long, length long"
)
MARK = "g long, file string, k string, t string, no_id boolean, i {id}, at long, n double, plain string"
#: The order of captures; null ids come last.
BY_KEY = ["k", "t", "no_id", "i"]


def mark_rows(id_type: str):
    """A row for each mark of a group's files with about how many captures follow it, and one for the last capture."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string() if id_type == "string" else pa.int64(), pa.int64(), pa.float64(), pa.string()]
        names = [x.split()[0] for x in MARK.split(", ")]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                held = json.loads(r["marks"])
                n = r["captures"] / len(held["marks"])
                for key, at in [*held["marks"], [held["last"], None]]:
                    rows.append((r["g"], r["file"], key[0], key[1], key[2] is None, key[2], at, 0.0 if at is None else n, json.dumps(key)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return run


def range_numbers(range_captures: int):
    """Adds r to marks in order: a new range begins with each group, and after about range_captures."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, r, size, last, group = TaskContext.get().partitionId() << 32, -1, 0.0, None, None
        for b in batches:
            out = []
            for g, key, n in zip(b.column("g").to_pylist(), b.column("plain").to_pylist(), b.column("n").to_pylist(), strict=True):
                if g != group or (size >= range_captures and key != last):
                    r, size = r + 1, 0.0
                group, last, size = g, key, size + n
                out.append(base + r)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "r"])

    return run


def plan_ranges(grouped: DataFrame, range_captures: int, id_type: str, task_marks: int = 65_536) -> DataFrame:
    """(g, part, low, high, starts) from the files of groups of runs (g, file, captures, marks): each group's key ranges
    of about range_captures, and for each the files that reach into it with the offset to start from.

    Marks are a table, dealt by ranges of their key; each task cuts its own. A file reaches from the range of one of its
    marks to that of the next, so a range meets a file as a row, not by looking through all. Only a short row for each
    range is put in order by one task.
    """
    marks = materialize(grouped.select("g", "file", "captures", "marks").mapInArrow(mark_rows(id_type), MARK.format(id=id_type)), "marks")
    tasks = max(1, -(-marks.count() // task_marks))
    in_order = marks.repartitionByRange(tasks, "g", *BY_KEY).sortWithinPartitions("g", *BY_KEY)
    marks = materialize(in_order.mapInArrow(range_numbers(range_captures), MARK.format(id=id_type) + ", r long"), "marks")
    ranges = marks.groupBy("g", "r").agg(F.min_by("plain", F.struct(*BY_KEY)).alias("low"))
    by_group = Window.partitionBy("g").orderBy("r")
    ranges = ranges.select(
        "g", "r", (F.row_number().over(Window.orderBy("r")) - 1).alias("part"), F.when(F.lag("r").over(by_group).isNotNull(), F.col("low")).alias("low"),
        F.lead("low").over(by_group).alias("high"),
    )
    ranges = materialize(ranges, "ranges")
    of_file = Window.partitionBy("g", "file").orderBy(*BY_KEY, F.col("at").isNull())
    reach = marks.join(ranges.select("r", "part"), "r").withColumn("to", F.lead("part").over(of_file)).where("at is not null")
    reach = reach.select("g", "file", "at", F.explode(F.sequence("part", F.coalesce("to", "part"))).alias("part"))
    starts = reach.groupBy("g", "part", "file").agg(F.min("at").alias("at")).groupBy("g", "part")
    starts = starts.agg(F.to_json(F.array_sort(F.collect_list(F.struct("file", "at")))).alias("starts"))
    return materialize(ranges.drop("r").join(starts, ["g", "part"]), "ranges")


def merged(fs, root: str, row: dict):
    """(key, capture) of a range in order."""
    low, high = (None if x is None else order(json.loads(x)) for x in (row["low"], row["high"]))
    return LoserTree([read_run(fs, f"{root}/{x['file']}", x["at"], low, high) for x in json.loads(row["starts"])])


def group_merger(uri: str, every: int):
    """Merges the range of each row to a file of its group's longer run."""

    def run(batches):
        fs, root = file_system(uri)
        for b in batches:
            for row in b.to_pylist():
                name = f"{uuid.uuid4().hex}.run"
                w = RunWriter(fs, f"{root}/{name}", every)
                for _, c in merged(fs, root, row):
                    w.add(c)
                found = file_row(str(row["g"]), name, w)
                if w.n:
                    yield found

    return run


def range_merger(uri: str, schema: str):
    """Merges the range of each row to rows of the histories."""

    def run(batches):
        fs, root = file_system(uri)
        for b in batches:
            for row in b.to_pylist():
                rows, n = [], 0
                for _, (key, time, i, rest) in merged(fs, root, row):
                    url, kind, digest, size, refers, archive, offset, length = rest
                    rows.append((row["part"], n, key, time, i, url, kind, digest, size, refers, archive, offset, length))
                    n += 1
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        import pyarrow as pa

        names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
        kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[k] for k in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def merge_runs(
    runs: DataFrame, uri: str, *, fan_in: int = 64, range_captures: int = 50_000, every: int = 512, id_type: str = "long"
) -> DataFrame:
    """The captures of all runs in global order: by (part, seq)."""
    schema = HISTORY.format(id=id_type)
    while True:
        names = runs.select("run").distinct()
        n = names.count()
        if not n:
            return runs.sparkSession.createDataFrame([], schema)
        groups = -(-n // fan_in)
        # Which run goes to which group doesn't matter; a hash of its name repeats on retries. A group that
        # gets too many is divided.
        named = names.select("run", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("h"))
        rank = F.floor((F.row_number().over(_by("h", "run")) - 1) / fan_in) if groups > 1 else F.lit(0)
        grouped = materialize(runs.join(named.select("run", (F.col("h") + groups * rank).cast("long").alias("g")), "run"), "groups")
        plan = plan_ranges(grouped, range_captures, id_type)
        tasks = plan.repartitionByRange(plan.count(), "g", "part")
        if groups == 1:
            return tasks.mapInArrow(range_merger(uri, schema), schema)
        runs = materialize(tasks.mapInArrow(group_merger(uri, every), RUN), "runs")


def in_order(histories: DataFrame) -> DataFrame:
    """The histories with ``position``, a capture's place (from 0) among all; only the sizes of parts are added up."""
    rows = materialize(histories, "histories")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(sizes, "part").withColumn("position", F.col("before") + F.col("seq")).drop("before")


def _by(group: str, order_by: str):
    return Window.partitionBy(group).orderBy(order_by)


def capture_histories(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None,
    epoch: int = 1_700_000_000, min_bytes: int = 100, fan_in: int = 64, run_captures: int = 200_000, range_captures: int = 50_000,
    uri: str | None = None,
) -> DataFrame:
    """Archives every row of pages and returns the merged index of the archives read back."""
    uri = uri or new_path(pages.sparkSession, "warc")
    decided = decide(pages, id_col, url_col, payload_col, time_col, min_bytes)
    manifest = write_archives(decided, uri, epoch=0 if time_col else epoch)
    runs = index_archives(manifest, uri, run_captures=run_captures)
    id_type = "string" if dict(pages.dtypes)[id_col] == "string" else "long"
    return merge_runs(runs, uri, fan_in=fan_in, range_captures=range_captures, id_type=id_type)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(capture_histories(table(spark, sf_dir, "pages"))).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "position"
    )


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         coalesce(url, '') AS url, '^([A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^#]*)' AS form,
         strftime(make_timestamp((1700000000 + (page_id % 4000000000 + 4000000000) % 4000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp
  FROM pages
), u AS (
  SELECT *, regexp_matches(url, form) AS whole, regexp_extract(url, form, 3) AS path,
         regexp_replace(regexp_replace(lower(regexp_extract(url, form, 2)), '^.*@', ''), '^www\d*\.', '') AS site
  FROM p
), k AS (
  SELECT *, CASE WHEN NOT whole THEN lower(split_part(url, '#', 1)) ELSE
           array_to_string(list_reverse(string_split(split_part(site, ':', 1), '.')), ',')
           || CASE WHEN regexp_replace(site, '^[^:]*:?', '') IN ('', '80', '443') THEN '' ELSE ':' || regexp_replace(site, '^[^:]*:?', '') END
           || ')' || lower(CASE WHEN path = '' THEN '/' ELSE path END) END AS url_key
  FROM u
), f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
       url_key, timestamp, row_number() OVER (ORDER BY url_key, timestamp, page_id) - 1 AS position
FROM k JOIN f USING (payload_digest)
"""
