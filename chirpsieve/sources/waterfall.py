"""Waterfalls from tables and arrays, and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_packed(df: DataFrame, chan: str, x: str, keep: Column | None = None) -> DataFrame:
    """chan, t, x from one array a channel; `keep` is pushed into the scan."""
    df = df.where(keep) if keep is not None else df
    return df.select(F.col(chan).cast("int").alias("chan"), F.posexplode(x).alias("t", "x")).withColumn("x", F.col("x").cast("double"))


def binned(df: DataFrame, chan: Column, t: Column, x: Column, nchans: int, nsamps: int, outside: str = "raise") -> DataFrame:
    """A dense waterfall of sums over (chan, t) bins, 0 where no row fell; rows outside raise, or are left out with outside="drop"."""
    spark = df.sparkSession
    got = df.select(chan.cast("int").alias("chan"), t.cast("int").alias("t"), x.cast("double").alias("x"))
    inside = (F.col("chan") >= 0) & (F.col("chan") < nchans) & (F.col("t") >= 0) & (F.col("t") < nsamps)
    if outside == "drop":
        got = got.where(inside)
    else:
        got = got.withColumn("t", F.when(F.coalesce(inside, F.lit(False)), F.col("t")).otherwise(F.raise_error(F.lit(f"a row lies outside the {nchans} x {nsamps} bins")).cast("int")))
    zero = spark.range(nchans * nsamps).select((F.col("id") / nsamps).cast("int").alias("chan"), (F.col("id") % nsamps).cast("int").alias("t"), F.lit(0.0).alias("x"))
    return got.unionByName(zero).groupBy("chan", "t").agg(F.sum("x").alias("x"))


def embeddings(spark: SparkSession, sf_dir: str, nchans: int) -> DataFrame:
    """obs, chan, t, x of every vector: nchans vectors in order of vec_id are one observation."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = df.select(F.floor(F.col("vec_id") / nchans).alias("obs"), F.pmod("vec_id", F.lit(nchans)).cast("int").alias("chan"), F.posexplode("embedding").alias("t", "x"))
    return x.withColumn("x", F.col("x").cast("double"))


def events(spark: SparkSession, sf_dir: str, nchans: int, nsamps: int = 64) -> DataFrame:
    """Channel = user_id mod nchans, sample = 12-hour bin from 2024-01-01, value in whole cents."""
    t = F.floor(F.timestamp_diff("HOUR", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("ts")) / 12)
    return binned(spark.read.parquet(f"{sf_dir}/events.parquet"), F.pmod("user_id", F.lit(nchans)), t, F.round(F.col("value") * 100), nchans, nsamps)


def lineitem(spark: SparkSession, sf_dir: str, nchans: int, nsamps: int = 120) -> DataFrame:
    """Channel = l_suppkey mod nchans, sample = month of shipping since 1992 (to 2001; other rows raise), quantity."""
    d = F.to_date("l_shipdate")
    return binned(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.pmod("l_suppkey", F.lit(nchans)), (F.year(d) - 1992) * 12 + F.month(d) - 1, F.col("l_quantity"), nchans, nsamps)


def from_matrix(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """A packed waterfall of one block from a (channel, sample) matrix."""
    rows = [(i, 0, [float(v) for v in r]) for i, r in enumerate(np.asarray(x, dtype=np.float32))]
    return spark.createDataFrame(rows, "chan int, block long, x array<float>")


def to_matrix(df: DataFrame, row: str = "i_dt", x: str = "v") -> np.ndarray:
    """The rows of a small packed result as one matrix on the driver."""
    return np.stack([np.asarray(r[x], dtype=np.float32) for r in df.select(row, x).orderBy(row).collect()])


def pack(wf: DataFrame, length: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, chan, block, x) with `length` samples in order of t; gaps are 0."""
    b = wf.withColumn("block", F.floor(F.col("t") / length)).withColumn("p", F.pmod("t", F.lit(length)))
    g = b.groupBy(*by, "chan", "block").agg(F.map_from_entries(F.collect_list(F.struct("p", F.col("x").cast("float").alias("x")))).alias("m"), F.max("p").alias("last"))
    return g.select(*by, "chan", "block", F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda i: F.coalesce(F.try_element_at("m", i.cast(wf.schema["t"].dataType)), F.lit(0.0).cast("float"))).alias("x"))


def unpack(packed: DataFrame, length: int, x: str = "x") -> DataFrame:
    """The inverse of pack for any array column: t and the value instead of block and the array."""
    keep = [c for c in packed.columns if c not in ("block", x)]
    return packed.select(*keep, "block", F.posexplode(x).alias("p", "value_")).select(*keep, (F.col("block") * length + F.col("p")).alias("t"), F.col("value_").alias(x))


def write(packed: DataFrame, path: str) -> None:
    """Parquet with blocks clustered in files, so that a range of blocks reads few of them."""
    packed.repartitionByRange("block").sortWithinPartitions("block", "chan").write.parquet(path)
