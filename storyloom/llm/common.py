"""What several operators of this subpackage share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points 0x09 to 0x0D and 0x20, as every contract here counts white space.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % mod


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else, by built-in functions."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8.

    bytes.lower() and bytes.split() know ASCII only, which is just what is asked for.
    """
    return utf8(text).lower().split()


def words_of(column):
    """words() of each text of an Arrow column, without decoding it."""
    import pyarrow as pa

    for raw in column.cast(pa.binary()):
        yield (raw.as_py() or b"").lower().split()


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def per_worker(key: str, make):
    """make()'s value, kept for the life of a Python worker."""
    import pyspark

    kept = vars(pyspark).setdefault("_storyloom_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def one_thread() -> None:
    """Spark runs a Python worker per core: libraries' own threads would only compete."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def send(spark: SparkSession, value):
    """Broadcasts a value; classes of this package go by value, too. See received()."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(held):
    from pyspark import cloudpickle

    return cloudpickle.loads(held.value)


def release() -> None:
    """Gives memory that a worker has freed back to the system, for what runs beside it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only some C libraries have it
