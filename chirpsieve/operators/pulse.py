"""Synthetic pulses, and the search for the strongest cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dispersion import delay_seconds
from ..plans.geometry import SIMULATOR_DISPERSION


def simulate_pulse(spark: SparkSession, f_min: float, f_max: float, nchans: int, nsamps: int, tsamp: float, dm: float, amp: float = 1.0, offset: int = 0, width: int = 1, noise_rms: float = 0.0, seed: int = 0, dispersion: float = SIMULATOR_DISPERSION) -> DataFrame:
    """chan, t, x: a boxcar at offset in every channel plus seeded noise, rolled back round the end by the channel's delay.

    Cells are made from one range over all of them, so the waterfall is spread
    over partitions from the start.
    """
    cells = spark.range(nchans * nsamps).select((F.col("id") / nsamps).cast("int").alias("chan"), (F.col("id") % nsamps).cast("int").alias("t"))
    f = F.col("chan") * ((f_max - f_min) / nchans) + F.lit(f_min)
    delay = F.rint(delay_seconds(F.lit(dm), F.lit(f_min), f, dispersion) / tsamp).cast("long")
    source = F.pmod(F.col("t") + delay, F.lit(nsamps))
    x = F.when((source >= offset) & (source < offset + width), F.lit(float(amp))).otherwise(F.lit(0.0))
    return cells.withColumn("x", x + F.randn(seed) * noise_rms if noise_rms else x)


def peak(out: DataFrame, row: str = "i_dt", k: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """The k largest cells (of each key, if any), ties by trial then sample. Nulls never win; fewer cells than k are all there.

    With keys and k > 1 each task keeps the k best of a key before the shuffle
    (for k up to 1,000), so a key of any size sends k rows a task.
    """
    out = out.where("v is not null")
    if by and k == 1:
        best = F.max(F.struct(F.col("v"), -F.col(row), -F.col("t"))).alias("b")
        return out.groupBy(*by).agg(best).select(*by, (-F.col("b.col2")).alias(row), (-F.col("b.col3")).alias("t"), F.col("b.v").alias("v"))
    if by:
        at = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("v"), row, "t"))
        return out.select(*by, row, "t", "v").withColumn("place", at).where(F.col("place") <= k)
    return out.orderBy(F.desc("v"), row, "t").limit(k)


def dm_bounds(trials: DataFrame) -> DataFrame:
    return trials.agg(F.min("dm").alias("dm_min"), F.max("dm").alias("dm_max"))
