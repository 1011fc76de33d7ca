"""Shared helpers: written intermediates in the cluster's shared folder, text hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SLOTS = 1 << 18
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


_written: list[tuple[SparkSession, str]] = []
_batches = threading.Lock()
_writing: dict[int, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_chirpsieve_dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="chirpsieve-")
            spark.sparkContext._chirpsieve_dir = found
    return found


@contextmanager
def small_batches(spark: SparkSession):
    """Whole texts go to Python in batches of 2,000 rows at most, until the last of concurrent writers is done."""
    with _batches:
        held = _writing.setdefault(id(spark), [0, spark.conf.get(ARROW_ROWS)])
        held[0] += 1
        spark.conf.set(ARROW_ROWS, str(min(int(held[1]), 2000) if int(held[1]) > 0 else 2000))
    try:
        yield
    finally:
        with _batches:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(ARROW_ROWS, _writing.pop(id(spark))[1])


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, executors may be lost.

    The driver's garbage is collected afterwards, so that Spark drops shuffle
    files of the finished jobs instead of keeping them for the whole query.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/chirpsieve-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """run, for mapInArrow, in a reused worker: before it, the word memory of operator 8 goes; at its end, what is free goes back.

    An executor's limit holds for its heap and all its workers together, and
    idle workers keep what they hold. packing.Encoder.shared() makes its memory
    anew when its turn comes.
    """

    def body(batches):
        if getattr(sys.modules.get("tokenizers"), "chirpsieve_encoders", None):
            sys.modules["tokenizers"].chirpsieve_encoders.clear()
            give_back()
        yield from run(batches)
        give_back()

    return body


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone already, or one folder can't be deleted
            continue


@contextmanager
def scratch():
    """Deletes at its end the tables written within: for long sessions, around a query and the write of its result."""
    before = len(_written)
    try:
        yield
    finally:
        _delete(_written[before:])
        del _written[before:]


@atexit.register
def _remove_written() -> None:
    _delete(_written)


def boxed(df: DataFrame, **more) -> DataFrame:
    """df as one struct column `row`, beside computed columns, so that no name of df can clash with another."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def words(text: bytes) -> list[bytes]:
    """bytes.split() cuts at exactly the six ASCII white-space bytes of WORD."""
    return text.split()


def word_hashes(ws: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def rolling(x: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2^64) of each k consecutive entries of x; len(x) - k + 1 values."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, p = np.zeros(n, dtype=np.uint64), 0, 1
    # doubling: hash of 2^j entries from two of 2^(j-1); the bits of k pick blocks
    block, size, mul = x, 1, base & (2**64 - 1)
    at, rest = 0, k
    while rest:
        if rest & 1:
            out = out * np.uint64(mul) + block[at : at + n]
            at += size
        rest >>= 1
        if rest:
            block = block[: len(block) - size] * np.uint64(mul) + block[size:]
            size, mul = size * 2, mul * mul % 2**64
    return out


def text_keys(text) -> list:
    """Two independent native 64-bit hashes of a text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slots(keys: DataFrame, key: str = "k1") -> DataFrame:
    """The hash slots that keys (64-bit) fall in, to be broadcast: SLOTS rows at most, however many keys there are.

    Rows of another slot have none of the keys, so a large table needs to
    shuffle only the others for an exact join; with very many keys all slots
    are taken, and nothing but the saving is lost.
    """
    return F.broadcast(keys.select(F.pmod(key, F.lit(SLOTS)).cast("int").alias("slot_")).distinct())


def slot(key: str = "k1"):
    return F.pmod(key, F.lit(SLOTS)).cast("int")
