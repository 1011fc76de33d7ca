"""The tree transform of rows (chan, t, x) with a single shuffle, of the samples: level by level, and in closed form.

Samples go to their key and block of time, all channels of it together, and lie
there as one array for each channel; all rows of all levels, many times the
samples' size, are made from these arrays and a broadcast plan, and nothing of
them is shuffled, sorted or hashed. A block has as many samples before it as
its trials look back on, so its work and memory depend on the geometry alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import frames
from ..plans.tree import TreePlan
from .tree import BLOCK, sums


def _later(row: Column, shift: Column) -> Column:
    """A row's values moved by `shift` behind zeros; what is moved beyond the end goes."""
    shift = F.least(shift, F.size(row))
    return F.concat(F.array_repeat(F.lit(0.0), shift), F.slice(row, F.lit(1), F.size(row) - shift))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _mean(s: Column, w: Column) -> Column:
    """Means of the last w + 1 samples from their sums, 0 where there are fewer."""
    n = F.size(s)
    part = F.zip_with(F.slice(s, w + 1, n - w), F.concat(F.array(F.lit(0.0)), F.slice(s, F.lit(1), n - w - 1)), lambda a, b: (a - b) / (w + 1))
    return F.when(w < n, F.concat(F.array_repeat(F.lit(0.0), w), part)).otherwise(F.array_repeat(F.lit(0.0), n))


def _rows(wf: DataFrame, plan: TreePlan, by: tuple[str, ...], absent: str, block: int, lineage: DataFrame) -> DataFrame:
    """*by, start, own, rows (level 0: an array for each channel and w) and lineage's columns; a row is a block with the samples that it looks back on.

    Samples are shuffled once, by block. All that comes of them, many times
    their size, is made and added up within the block's row.
    """
    g = plan.geometry
    if absent not in ("raise", "zero"):
        raise ValueError("absent channels raise, or count as zero")
    x = sums(wf, plan, by, block, plan.halo(), True)
    x = x.groupBy(*by, "block").agg(F.first("start").alias("start"), F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("chan", "s"))).alias("held"))
    zeros = F.transform(F.get("held", F.lit(0))["s"], lambda _: F.lit(0.0))
    lacking = F.transform(F.sequence(F.lit(0), F.lit(g.nchans - 1)), lambda c: F.coalesce(F.get(F.filter("held", lambda e: e["chan"] == c), F.lit(0))["s"], zeros))
    if absent == "raise":
        lacking = F.raise_error(F.lit(f"a waterfall of {g.nchans} x {g.nsamps} is needed: a channel is missing")).cast("array<array<double>>")
    x = x.withColumn("sums", F.when(F.size("held") == g.nchans, F.col("held")["s"]).otherwise(lacking)).drop("held")
    p = frames.packed_channels(wf.sparkSession, plan)
    rows = F.transform("channels", lambda r: _mean(F.get("sums", r["chan"]), r["w"]))
    # frames of one row each: the plan goes to the blocks
    return x.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(lineage)).select(*by, "start", "own", rows.alias("rows"), *lineage.columns)


def _finished(x: DataFrame, out: Column, plan: TreePlan, by: tuple[str, ...], dense: bool) -> DataFrame:
    """*by, i_dt, dt, dm, t, v of the blocks' own samples, from their trials' arrays."""
    g, i_dt, t = plan.geometry, F.col("i_dt"), F.col("t")
    x = x.select(*by, "start", "own", F.posexplode(out).alias("i_dt", "row"))
    skip = F.col("own") - F.col("start")
    x = x.select(*by, "i_dt", "own", F.posexplode(F.slice("row", skip + 1, F.size("row") - skip)).alias("at", "v"))
    dt = (F.lit(int(plan.dt_grid[0])) + i_dt * g.dt_step).cast("int")
    x = x.select(*by, "i_dt", dt.alias("dt"), (dt * F.lit(g.dm_step)).alias("dm"), (F.col("own") + F.col("at")).cast("int").alias("t"), "v")
    return x if dense else x.where(t >= F.get(F.lit([int(v) for v in plan.lowest()]), i_dt))


def tree_packed(wf: DataFrame, plan: TreePlan, by: tuple[str, ...] = (), dense: bool = True, absent: str = "raise", block: int = BLOCK) -> DataFrame:
    """What tree.tree_transform gives: *by, i_dt, dt, dm, t, v by log2(nchans) merges, each row of a band shared by all trials above it."""
    x = _rows(wf, plan, by, absent, block, frames.packed_levels(wf.sparkSession, plan))
    merged = lambda rows, r: F.when(r["head"] < 0, F.get(rows, r["tail"])).otherwise(_added(F.get(rows, r["tail"]), _later(F.get(rows, r["head"]), r["shift"])))
    out = F.aggregate("levels", F.col("rows"), lambda rows, level: F.transform(level, lambda r: merged(rows, r)))
    return _finished(x, out, plan, by, dense)


def flat_packed(wf: DataFrame, plan: TreePlan, by: tuple[str, ...] = (), dense: bool = True, absent: str = "raise", block: int = BLOCK) -> DataFrame:
    """What tree.flat_transform gives, by one sum over a trial's channels; for small grids (frames.MOST_FLAT)."""
    x = _rows(wf, plan, by, absent, block, frames.packed_flat(wf.sparkSession, plan))
    later = lambda r: _later(F.get("rows", r["row"]), r["shift"])
    out = F.transform("trials", lambda rs: F.aggregate(F.slice(rs, 2, F.size(rs)), later(F.get(rs, F.lit(0))), lambda v, r: _added(v, later(r))))
    return _finished(x, out, plan, by, dense)
