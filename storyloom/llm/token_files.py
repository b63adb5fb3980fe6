"""Token ids in binary files: a static range asymmetric numeral system with one shared table.

1. ``tokenise``: every whole text becomes its ids and one end id, once, in a written table.
2. ``frequencies``: the ids of the corpus are counted with partial sums; counts become frequencies that
   add up to 2**20, at least 1 for an id that occurs. The table goes to a file of its own beside the data.
3. ``write_tokens``: documents are dealt to files by ranges of their id, in ascending order. A file is a
   stream of ids, cut into blocks that are encoded independently: id number i of a block belongs to
   lane i modulo the number of lanes, all lanes share one stream of words, and their states are saved every
   ``segment`` ids as checkpoints.
4. ``read_tokens``: the files are read back by ranges of checkpoints in parallel. A document belongs to the
   range in which it starts, and whoever reads it goes on into later segments until it ends. Every
   segment's words, its ids and the file's index have checksums, and a wrong one raises an error.

A file is a header, the blocks' words (little-endian, 32 bits), an index of checkpoints and one of documents
(Arrow streams) and a trailer that tells where these are. File names hold a random part and only files of the
written manifest count, so files of failed or repeated tasks are never read. Files are written and read
through pyarrow.fs, for which the shared folder's address must be one that it knows (file, hdfs, s3, gs).

Memory is bounded: a task holds a block, a range of checkpoints, or a file's indexes.

Defined results: a null or empty text is the end id alone. A null id comes before all others. Repeated rows
are documents of their own, one after the other; rows of one id are in the order of the read table.
Lengths and ids may be of any size; a vocabulary of more than 2**20 ids that occur raises an error. An empty
table gives an empty manifest and no documents. Only the named columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import one_thread, per_worker, received, send, table
from storyloom.llm.packing import Encoder, default_vocabulary, read_files
from storyloom.llm.warc import file_system
from storyloom.shared import materialize, new_path

MAGIC = b"SLTF"
HEADER, TRAILER = "<4sBBHI", "<QQI4s"
HEAD_BYTES, TAIL_BYTES = struct.calcsize(HEADER), struct.calcsize(TRAILER)
BITS = 20  #: frequencies add up to 2**BITS
LOW = 1 << 31  #: a lane's state is in [LOW, LOW << 32)


def normalise(counts):
    """Frequencies of sum 2**BITS for counts, at least 1 where a count isn't 0."""
    import numpy as np

    counts = np.asarray(counts, np.float64)
    seen = counts > 0
    if seen.sum() > 1 << BITS:
        raise ValueError(f"{int(seen.sum())} different ids don't fit {1 << BITS} slots")
    if not seen.any():
        return np.zeros(len(counts), np.uint64)
    out = np.where(seen, np.maximum(1, np.floor(counts / counts.sum() * (1 << BITS))), 0).astype(np.int64)
    over = int(out.sum()) - (1 << BITS)
    for k in np.argsort(-out, kind="stable").tolist():
        if over <= 0:
            out[k] -= over
            break
        take = min(over, int(out[k]) // 2)
        out[k] -= take
        over -= take
    return out.astype(np.uint64)


class Table:
    """The shared frequencies: of each id, how many slots it has, where these start, and whose a slot is."""

    def __init__(self, frequencies) -> None:
        import numpy as np

        self.frequency = np.asarray(frequencies, np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.frequency)[:-1])).astype(np.uint64)
        self.owner = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        self.crc = zlib.crc32(self.frequency.astype("<u4").tobytes())


def encode(ids, table: Table, lanes: int, every: int):
    """(words, checkpoints) of a block; a checkpoint for each ``every`` steps, in order, is (words before it,
    the lanes' states). A step is an id in each lane."""
    import numpy as np

    f, s = table.frequency[ids], table.start[ids]
    if not f.all():
        raise ValueError("an id has no slot in the table")
    limit, low32, down = f << np.uint64(63 - BITS), np.uint64(0xFFFFFFFF), np.uint64(32)
    x, bits = np.full(lanes, LOW, np.uint64), np.uint64(BITS)
    words, points, done = [], [], 0
    for step in range(-(-len(ids) // lanes) - 1, -1, -1):
        at = slice(step * lanes, (step + 1) * lanes)
        fs = f[at]
        y = x[: len(fs)]
        full = y >= limit[at]
        if full.any():
            words.append((y[full] & low32).astype("<u4"))
            done += len(words[-1])
            y = np.where(full, y >> down, y)
        q = y // fs
        x[: len(fs)] = (q << bits) + (y - q * fs) + s[at]
        if step % every == 0:
            points.append((done, x.tobytes()))
    words = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    return words, [(len(words) - left, states) for left, states in reversed(points)]


def decode(states: bytes, words, n: int, table: Table):
    """The n ids from a checkpoint on."""
    import numpy as np

    x = np.frombuffer(states, np.uint64).copy()
    lanes, mask, bits, down, low = len(x), np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(LOW)
    out, at = np.empty(n, np.uint32), 0
    words = words.astype(np.uint64)
    for k in range(0, n, lanes):
        y = x[: min(lanes, n - k)]
        slot = y & mask
        ids = table.owner[slot]
        y = table.frequency[ids] * (y >> bits) + slot - table.start[ids]
        short = np.flatnonzero(y < low)
        y[short] = (y[short] << down) | words[at : at + len(short)]
        at += len(short)
        x[: len(y)] = y
        out[k : k + len(y)] = ids
    if at != len(words):
        raise ValueError("a segment holds more words than its ids take")
    return out


def ipc(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


class FileWriter:
    """Appends documents to a file, block by block."""

    def __init__(self, fs, path: str, table: Table, id_type, lanes: int, segment: int, block: int) -> None:
        self.out, self.table, self.id_type = fs.open_output_stream(path, compression=None), table, id_type
        self.lanes, self.segment, self.block = lanes, segment, block
        self.out.write(struct.pack(HEADER, MAGIC, 1, BITS, lanes, table.crc))
        self.at, self.n_ids, self.held, self.waiting = HEAD_BYTES, 0, [], 0
        self.segments: list[tuple] = []
        self.documents: list = []
        self.lengths: list[int] = []

    def add(self, i, ids) -> None:
        self.documents.append(i)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._write(False)

    def _write(self, last: bool) -> None:
        import numpy as np

        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, end, self.block):
            part = ids[k : min(k + self.block, end)].astype("<u4")
            words, points = encode(part, self.table, self.lanes, self.segment // self.lanes)
            ends = [w for w, _ in points[1:]] + [len(words)]
            for j, ((w, states), e) in enumerate(zip(points, ends, strict=True)):
                own = part[j * self.segment : (j + 1) * self.segment]
                raw = words[w:e].tobytes()
                self.segments.append((self.at + 4 * w, e - w, self.n_ids, len(own), states, zlib.crc32(raw, zlib.crc32(states)), zlib.crc32(own.tobytes())))
                self.n_ids += len(own)
            self.out.write(words.tobytes())
            self.at += 4 * len(words)
        self.held, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, segments)"""
        import pyarrow as pa

        self._write(True)
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int64()]
        names = ["offset", "n_words", "first", "n_ids", "states", "crc", "ids_crc"]
        columns = zip(*self.segments, strict=True) if self.segments else [[]] * len(names)
        index = ipc(pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names))
        documents = ipc(pa.table([pa.array(self.documents, self.id_type), pa.array(self.lengths, pa.int64())], ["id", "n_tokens"]))
        self.out.write(index)
        self.out.write(documents)
        self.out.write(struct.pack(TRAILER, self.at, self.at + len(index), zlib.crc32(documents, zlib.crc32(index)), MAGIC))
        self.out.close()
        return len(self.lengths), self.n_ids, len(self.segments)


class FileReader:
    """Decodes the documents that start in a range of a file's segments."""

    def __init__(self, fs, path: str, table: Table) -> None:
        import numpy as np
        import pyarrow as pa

        self.path, self.table, self.file = path, table, fs.open_input_file(path)
        size = self.file.size()
        magic, version, bits, _, crc = struct.unpack(HEADER, self.file.read_at(HEAD_BYTES, 0))
        index, documents, check, end = struct.unpack(TRAILER, self.file.read_at(TAIL_BYTES, size - TAIL_BYTES))
        if (magic, version, bits, end) != (MAGIC, 1, BITS, MAGIC):
            raise ValueError(f"{path} isn't a token file")
        if crc != table.crc:
            raise ValueError(f"{path} was written with another table")
        raw = self.file.read_at(size - TAIL_BYTES - index, index)
        if zlib.crc32(raw) != check:
            raise ValueError(f"{path}: the index isn't what was written")
        read = lambda part: pa.ipc.open_stream(part).read_all()
        self.segments = read(raw[: documents - index]).to_pylist()
        found = read(raw[documents - index :])
        self.ids, self.ends = found.column("id").combine_chunks(), np.cumsum(found.column("n_tokens").to_numpy())

    def segment(self, k: int):
        import numpy as np

        s = self.segments[k]
        raw = self.file.read_at(4 * s["n_words"], s["offset"])
        if zlib.crc32(raw, zlib.crc32(s["states"])) != s["crc"]:
            raise ValueError(f"{self.path}: segment {k} isn't what was written")
        ids = decode(s["states"], np.frombuffer(raw, "<u4"), s["n_ids"], self.table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != s["ids_crc"]:
            raise ValueError(f"{self.path}: segment {k} has other ids than were written")
        return ids

    def documents(self, first: int, last: int):
        """(id, start, ids) of the documents that start in segments [first, last)."""
        import numpy as np

        low = self.segments[first]["first"]
        high = self.segments[last - 1]["first"] + self.segments[last - 1]["n_ids"]
        starts = np.concatenate(([0], self.ends[:-1]))
        a, b = np.searchsorted(starts, [low, high])
        k, held, base = first, np.empty(0, np.uint32), low  # held has the ids from base on
        for d in range(a, b):
            start, end = int(starts[d]), int(self.ends[d])
            parts = [held]
            have = base + len(held)
            while have < end:
                parts.append(self.segment(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            held, base = held[start - base :], start
            yield self.ids[d], start, held[: end - start]


def tokenise(docs: DataFrame, id_col: str, text_col: str, end_id: int, vocabulary: str, ranks: str) -> DataFrame:
    """(id, uid, n, ids): each row's ids, compressed, little-endian, 32 bits; a written table."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    files = read_files(vocabulary, ranks)
    held, key = send(docs.sparkSession, files), f"encoder {zlib.crc32(files[0])} {zlib.crc32(files[1])}"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = per_worker(key, lambda: Encoder(*received(held)))
        for b in batches:
            n, ids = [], []
            for text in b.column("text"):
                found = np.array([*encoder.ids(text.as_py() or ""), end_id], "<u4")
                n.append(len(found))
                ids.append(squeeze(found))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["id", "n", "ids"])

    found = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n long, ids binary")
    return materialize(found.withColumn("uid", F.monotonically_increasing_id()), "ids")


def squeeze(ids) -> bytes:
    """Ids in 16 bits where they fit, and compressed."""
    import pyarrow as pa

    short = not len(ids) or int(ids.max()) < 1 << 16
    return bytes([short]) + pa.Codec("zstd", 3).compress((ids.astype("<u2") if short else ids).tobytes(), asbytes=True)


def unsqueeze(raw: bytes, n: int):
    import numpy as np
    import pyarrow as pa

    size, kind = (2, "<u2") if raw[0] else (4, "<u4")
    return np.frombuffer(pa.Codec("zstd").decompress(raw[1:], n * size), kind).astype(np.uint32)


def frequencies(tokens: DataFrame):
    """The shared frequencies; their number is that of the vocabulary, whatever the corpus."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(1, np.int64)
        for b in batches:
            for n, raw in zip(b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                own = np.bincount(unsqueeze(raw, n))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    counts = tokens.select("n", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return np.zeros(0, np.uint64)
    out = np.zeros(max(counts.column("token").to_pylist()) + 1, np.int64)
    out[counts.column("token").to_numpy()] = counts.column("n").to_numpy()
    return normalise(out)


MANIFEST = "part long, file string, n_docs long, n_ids long, n_segments long"


def write_tokens(
    docs: DataFrame, uri: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, vocabulary: str | None = None,
    ranks: str | None = None, lanes: int = 256, segment: int = 1 << 16, block: int = 1 << 18, file_ids: int = 1 << 26,
) -> DataFrame:
    """Writes the files under uri; the manifest (part, file, n_docs, n_ids, n_segments) is a written table.

    lanes divides segment and segment divides block. Files hold about file_ids ids, or fewer if there are
    shuffle partitions for it.
    """
    if segment % lanes or block % segment:
        raise ValueError("lanes must divide segment, and segment must divide block")
    spark = docs.sparkSession
    standard = default_vocabulary() if not (vocabulary and ranks) else ("", "")
    tokens = tokenise(docs, id_col, text_col, end_id, vocabulary or standard[0], ranks or standard[1])
    shared = frequencies(tokens)
    fs, root = file_system(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/table.bin", compression=None) as out:
        out.write(shared.astype("<u4").tobytes())
    held = send(spark, shared)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    files = max(-(-total // file_ids), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block)), 1)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = file_system(uri)
        writer, name = None, f"{uuid.uuid4().hex}.tok"
        for b in batches:
            for i, n, raw in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if writer is None:
                    writer = FileWriter(fs, f"{root}/{name}", Table(received(held)), b.schema.field("id").type, lanes, segment, block)
                writer.add(i, unsqueeze(raw, n))
        if writer is not None:
            row = [TaskContext.get().partitionId(), name, *writer.close()]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["part", "file", "n_docs", "n_ids", "n_segments"])

    ordered = tokens.repartitionByRange(files, "id", "uid").sortWithinPartitions("id", "uid")
    return materialize(ordered.select("id", "n", "ids").mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, uri: str, id_type: str = "long", *, segments: int = 16, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, and ids) of every document in the files; start counts the ids of all
    documents before it. ``segments`` checkpoints are read by a task at once."""
    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # A row per file is all that is in order here.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = manifest.where("n_segments > 0").withColumn("before", before).select(
        "file", "before", "n_segments", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_segments") - 1, F.lit(segments).cast("long"))).alias("first")
    )
    ranges = materialize(ranges, "ranges")
    tasks = max(1, min(ranges.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        one_thread()
        fs, root = file_system(uri)

        def load():
            with fs.open_input_stream(f"{root}/table.bin", compression=None) as f:
                return Table(np.frombuffer(f.read(), "<u4"))

        shared, reader = per_worker(f"table {uri}", load), None
        for b in batches:
            for r in b.to_pylist():
                if reader is None or reader.path != f"{root}/{r['file']}":
                    reader = FileReader(fs, f"{root}/{r['file']}", shared)
                out, size = [], 0
                for i, start, ids in reader.documents(r["first"], min(r["first"] + segments, r["n_segments"])):
                    out.append((i, r["before"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                    size += len(ids)
                    if len(out) >= 8192 or (with_ids and size >= 1 << 22):
                        yield rows(out, reader)
                        out, size = [], 0
                if out:
                    yield rows(out, reader)

    def rows(out, reader):
        import pyarrow as pa

        i, *numbers, ids = zip(*out, strict=True)
        columns = [pa.array([x.as_py() for x in i], reader.ids.type), *(pa.array(c, pa.int64()) for c in numbers)]
        names = ["id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return ranges.repartitionByRange(tasks, "before", "first").sortWithinPartitions("before", "first").mapInArrow(run, schema)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, uri = table(spark, sf_dir, "documents"), new_path(spark, "tokens")
    found = read_tokens(write_tokens(docs, uri), uri, dict(docs.dtypes)["doc_id"])
    return found.withColumnRenamed("id", "doc_id")
