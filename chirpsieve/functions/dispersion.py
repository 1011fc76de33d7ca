"""Scalar and array functions as Columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.geometry import DISPERSION, SIMULATOR_DISPERSION, dm_range


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def inverse_square(f) -> Column:
    return F.pow(_c(f), F.lit(-2.0))


def share(a, b, c, d) -> Column:
    """The part of the delay over (c, d) that falls in (a, b); 0 for an empty band."""
    return (inverse_square(a) - inverse_square(b)) / (inverse_square(c) - inverse_square(d))


def band_delay(a, b, f_min, f_max, dt) -> Column:
    """dt's share in (a, b), halves rounded away from zero."""
    return F.round(_c(dt) * share(a, b, f_min, f_max)).cast("int")


def delay_grid(lo, hi, step) -> Column:
    """lo, lo + step, ... up to hi; empty where lo is above hi."""
    return F.when(_c(lo) <= _c(hi), F.sequence(_c(lo), _c(hi), _c(step))).otherwise(F.expr("cast(array() as array<int>)"))


def closest_index(values, want) -> Column:
    """Index (from 0) of the nearest entry of a sorted array; ties go up; null for an empty array.

    An exact hit on repeated entries gives the first; from below, the last of a group.
    """
    a, v = _c(values), _c(want)
    below = F.size(F.filter(a, lambda x: x < v))
    last = F.size(a) - 1
    lower = v - F.try_element_at(a, below) < F.try_element_at(a, below + 1) - v
    return F.when(F.size(a) <= 0, F.lit(None).cast("int")).when(below > last, last).when((below > 0) & lower, below - 1).otherwise(below)


def dm_of_delay(dt, f_min, f_max, tsamp, dispersion: float = DISPERSION) -> Column:
    return _c(dt) * (_c(tsamp) / (F.lit(dispersion) * (inverse_square(f_min) - inverse_square(f_max))))


def delay_seconds(dm, f_min, f, dispersion: float = SIMULATOR_DISPERSION) -> Column:
    """Delay of the band's lowest frequency behind f, in seconds (0 or more)."""
    return _c(dm) * F.lit(dispersion) * (inverse_square(f_min) - inverse_square(f))


def dm_delays(spark: SparkSession, dm: float, f_min: float, f_max: float, tsamp: float, nchans: int, in_samples: bool = True, dispersion: float = SIMULATOR_DISPERSION) -> DataFrame:
    """chan, delay: in samples (halves to even) or in seconds."""
    f = F.col("chan") * ((f_max - f_min) / nchans) + F.lit(f_min)
    sec = delay_seconds(F.lit(dm), F.lit(f_min), f, dispersion)
    return spark.range(nchans).select(F.col("id").cast("int").alias("chan")).withColumn("delay", F.rint(sec / tsamp).cast("int") if in_samples else sec)


def dm_list(spark: SparkSession, dm_max: float, dm_step: float, dm_min: float = 0.0) -> DataFrame:
    """i_dm, dm: the trial DMs of a range, its end included where it is on the grid."""
    n = len(dm_range(dm_max, dm_step, dm_min))
    return spark.range(n).select(F.col("id").cast("int").alias("i_dm"), (F.col("id") * dm_step + F.lit(float(dm_min))).alias("dm"))


def niters(nchans) -> Column:
    """Merges that bring so many channels to one band."""
    return F.ceil(F.log2(_c(nchans))).cast("int")


def add_offset(a, b, offset, n_out) -> Column:
    """a + (b moved right by offset), on n_out cells; what b has beyond a's end follows, then zeros.

    Raises where sizes differ, n_out is too small or the offset isn't within the arrays.
    """
    a, b, off, n = _c(a), _c(b), _c(offset), _c(n_out)
    size = F.size(a)
    value = lambda t: F.when(t < off, F.get(a, t)).when(t < size, F.get(a, t) + F.get(b, t - off)).when((t - off < size), F.get(b, t - off)).otherwise(F.lit(0.0))
    ok = (size == F.size(b)) & (n >= size) & (off >= 0) & (off < size)
    return F.when(F.assert_true(ok, F.lit("add_offset: sizes differ, or the output or offset doesn't fit")).isNull(), F.transform(F.sequence(F.lit(0), n - 1), value))


def copy_into(a, n_out) -> Column:
    """a followed by zeros on n_out cells; raises where n_out is smaller than a."""
    a, n = _c(a), _c(n_out)
    cells = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda t: F.coalesce(F.get(a, t), F.lit(0.0)))).otherwise(F.expr("cast(array() as array<double>)"))
    return F.when(F.assert_true(n >= F.size(a), F.lit("copy_into: the output is smaller than the input")).isNull(), cells)
