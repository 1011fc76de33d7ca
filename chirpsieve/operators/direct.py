"""The direct transform over long waterfalls: a sum over channels along each trial DM."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import frames
from ..plans.geometry import DirectGeometry
from .tree import inside


def direct_transform(wf: DataFrame, g: DirectGeometry, nsamps: int, by: tuple[str, ...] = (), masked: tuple[int, ...] = (), absent: str = "raise") -> DataFrame:
    """*by, i_dm, dm, t, v: the sum over channels of x[c, t + delay(dm, c)], for every t with all samples at hand.

    Delays are signed (0 or less for DMs of 0 or more), so t is the arrival in
    the lowest channel; masked channels count as zeros. A cell that lacks a
    channel's sample, or has one twice, raises (samples that no cell uses aren't
    looked at); with absent="zero" it is summed from what is there.
    """
    d = g.delays()
    lo, hi = int(max(0, -d.min())), int(nsamps - max(0, d.max()))
    if lo >= hi:
        raise ValueError("the recording is shorter than the largest delay")
    p = F.broadcast(frames.delays(wf.sparkSession, g))
    x = inside(wf, g.nchans, nsamps)
    x = x.where(~F.col("chan").isin(list(masked))) if masked else x
    x = x.join(p, "chan").withColumn("t", (F.col("t") - F.col("delay")).cast("int")).where((F.col("t") >= lo) & (F.col("t") < hi))
    keys, v = (*by, "i_dm", "dm", "t"), F.sum("x").alias("v")
    if absent == "zero":
        return x.groupBy(*keys).agg(v)
    used = [c for c in range(g.nchans) if c not in masked]
    # each channel once: as many rows, whose marks add up (without carries) to a known one
    mark = 0
    for c in used:
        mark ^= xxhash.xxh64_intdigest(c.to_bytes(4, "little"), 42)
    mark -= (mark >> 63) << 64
    x = x.groupBy(*keys).agg(v, F.count(F.lit(1)).alias("n_"), F.bit_xor(F.xxhash64(F.col("chan").cast("int"))).alias("mark_"))
    wrong = F.raise_error(F.lit(f"a waterfall of {g.nchans} x {nsamps} is needed: a cell is missing or repeated")).cast("double")
    ok = (F.col("n_") == len(used)) & (F.col("mark_") == mark)
    return x.select(*keys, F.when(ok, F.col("v")).otherwise(wrong).alias("v"))


def direct_matrix(x: np.ndarray, g: DirectGeometry, masked: tuple[int, ...] = ()) -> np.ndarray:
    """(DM, sample - reach) from a whole (channel, sample) matrix."""
    if x.ndim != 2 or x.shape[0] != g.nchans:
        raise ValueError(f"a waterfall of {g.nchans} channels is needed")
    d = g.delays()
    lo, hi = max(0, -d.min()), x.shape[1] - max(0, d.max())
    if lo >= hi:
        raise ValueError("the recording is shorter than the largest delay")
    out = np.zeros((len(g.dms), hi - lo))
    for i in range(len(out)):
        for c in range(g.nchans):
            if c not in masked:
                out[i] += x[c, lo + d[i, c] : hi + d[i, c]]
    return out
