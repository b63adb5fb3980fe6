"""All pairs of rows, in a slot of time and with the next one, by files of blocks.

Rows are written once, in the order of slot and id (or another one), to files of at most ``block_rows`` rows of one slot. A table of
files is joined to the pairs of files that meet, and a task reads the two files of each of its pairs. So nothing is
shuffled more than once, whatever the number of pairs; only reading, and comparing, grow with their square. A task holds
two blocks. Files are read and written through pyarrow.fs; those that a failed task leaves are in no table, and
never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.shared import materialize, new_path


def block_writer(uri: str, block_rows: int, prepare):
    """Writes rows, sorted by slot, to files; prepare makes a file's table of its rows. Returns slot and file."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(uri)
        held, size, last = [], 0, None

        def done():
            name = f"{uuid.uuid4().hex}.block"
            rows = prepare(pa.Table.from_batches(held))
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out, pa.ipc.new_stream(out, rows.schema) as w:
                w.write_table(rows)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([name])], ["slot", "file"])

        for b in batches:
            slots, at = b.column("slot").to_numpy(), 0
            while at < b.num_rows:
                if held and (slots[at] != last or size >= block_rows):
                    yield done()
                    held, size = [], 0
                n = min(int(np.searchsorted(slots, slots[at], side="right")) - at, block_rows - size)
                held.append(b.slice(at, n))
                size, last, at = size + n, int(slots[at]), at + n
        if held:
            yield done()

    return run


def block_reader(uri: str, compare):
    """Rows of compare(x, y, same) for each pair of files (x, y)."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as files

        fs, root = files.FileSystem.from_uri(uri)

        def read(name):
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                return pa.ipc.open_stream(f).read_all().combine_chunks()

        name = left = None
        for b in batches:
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if x != name:
                    name, left = x, read(x)
                for found in compare(left, left if x == y else read(y), x == y):
                    if found.num_rows:
                        yield found

    return run


def compare_blocks(rows: DataFrame, block_rows: int, compare, schema: str, *, next_slot: bool, prepare=lambda t: t, order=("slot", "id")) -> DataFrame:
    """What compare yields, batches of the schema, for every two blocks of rows (slot, id, ...) of one slot, each block with itself
    among them, and with next_slot of a slot and the one after it. order: what blocks are cut by, the slot first."""
    spark = rows.sparkSession
    uri = new_path(spark, "blocks")
    from pyarrow import fs as files

    fs, root = files.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    rows = rows.where(F.col("slot").isNotNull())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = materialize(ordered.mapInArrow(block_writer(uri, block_rows, prepare), "slot long, file string"), "blocks")
    x, y = blocks.select("slot", F.col("file").alias("x")), blocks.select("slot", F.col("file").alias("y"))
    pairs = x.join(y, "slot").where("x <= y").select("x", "y")
    if next_slot:
        pairs = pairs.unionAll(x.join(y.withColumn("slot", F.col("slot") - 1), "slot").select("x", "y"))
    pairs = materialize(pairs, "pairs")
    n = pairs.count()
    if not n:
        return spark.createDataFrame([], schema)
    parts = min(n, 64 * spark.sparkContext.defaultParallelism)
    return pairs.repartitionByRange(parts, "x", "y").sortWithinPartitions("x", "y").mapInArrow(block_reader(uri, compare), schema)
