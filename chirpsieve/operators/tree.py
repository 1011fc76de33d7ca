"""The tree transform over long waterfalls (chan, t, x): level by level, and in closed form.

Both are an equi-join with a broadcast plan and one sum per level. Optional key
columns (an observation, a beam) are carried through as further group keys.
A sum's cells are shuffled; where all trials of many cells are wanted, packed.py
shuffles the samples alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import frames
from ..plans.tree import TreePlan

BLOCK = 1024  # samples of a channel whose sums are made together


def inside(wf: DataFrame, nchans: int, nsamps: int) -> DataFrame:
    """wf, whose rows raise where their channel or sample is not one of the geometry's (checked as rows pass; no job of its own)."""
    ok = F.col("chan").between(0, nchans - 1) & F.col("t").between(0, nsamps - 1)
    wrong = F.raise_error(F.lit(f"a waterfall of {nchans} x {nsamps} is needed: a row lies outside")).cast(wf.schema["chan"].dataType)
    # in the key of the joins that follow, so that no row is lost before it is looked at
    return wf.withColumn("chan", F.when(F.coalesce(ok, F.lit(False)), F.col("chan")).otherwise(wrong))


def sums(wf: DataFrame, plan: TreePlan, by: tuple[str, ...], block: int, reach: int, together: bool) -> DataFrame:
    """*by, block, chan, start, own, stop, s: each channel's sums from `start` on, `reach` samples before the block's own, to `stop`.

    together: all channels of a block lie in one partition, else each where its
    own hash says. A cell that is missing or repeated raises.
    """
    g, t, b = plan.geometry, F.col("t"), F.col("block")
    length = max(block, reach, 1)
    last = (g.nsamps - 1) // length
    x = inside(wf, g.nchans, g.nsamps).select(*by, "chan", "t", F.coalesce("x", F.lit(0.0)).alias("x"))
    first = F.floor(t / length).cast("int")
    x = x.withColumn("block", F.explode(F.sequence(first, F.least(F.lit(last), F.floor((t + reach) / length).cast("int")))) if last else first)
    keys = (*by, "chan", "block")
    # many cells come of a sample: as many tasks as shuffles have, however few the samples' bytes are
    x = x.repartition(int(wf.sparkSession.conf.get("spark.sql.shuffle.partitions")), *((*by, "block") if together else keys))
    over = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    running = x.select(*keys, "t", F.sum("x").over(over).alias("s"))
    # rows of a block lie together already: nothing is shuffled here
    packed = running.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "s"))).alias("held"))
    start, stop = F.greatest(F.lit(0), b * length - reach), F.least(F.lit(g.nsamps), (b + 1) * length) - 1
    whole = (F.size("held") == stop - start + 1) & F.forall(F.transform("held", lambda e, i: e["t"] == start + i), lambda ok: ok)
    held = F.when(whole, F.col("held")).otherwise(F.raise_error(F.lit(f"a waterfall of {g.nchans} x {g.nsamps} is needed: a cell is missing or repeated")))
    return packed.select(*by, "block", "chan", start.alias("start"), (b * length).alias("own"), stop.alias("stop"), held["s"].alias("s"))


def means(wf: DataFrame, plan: TreePlan, by: tuple[str, ...] = (), dense: bool = False, block: int = BLOCK) -> DataFrame:
    """*by, chan, i_dt, w, t, v: mean of the last w + 1 samples of each channel, for each w of its grid, where they all exist (dense: 0 before).

    A channel is cut into blocks, each with as many samples before it as the
    longest w, so no window is longer than that. Sums from a block's beginning
    are made once; a mean is the difference of two of them, whatever its w. A
    cell that is missing or repeated raises; a null sample counts as 0.
    """
    p = frames.channels(wf.sparkSession, plan)
    packed = sums(wf, plan, by, block, int(plan.levels[0].delay.max()), False)
    first = F.col("own") if dense else F.greatest("own", "w")
    upto = lambda u: F.coalesce(F.get("s", u - F.col("start")), F.lit(0.0))
    mean = lambda u: (upto(u) - upto(u - F.col("w") - 1)) / (F.col("w") + 1)
    cells = F.transform(F.sequence(first, "stop"), lambda u: F.when(u >= F.col("w"), mean(u)).otherwise(0.0) if dense else mean(u))
    out = packed.join(F.broadcast(p), "chan").where(first <= F.col("stop"))
    out = out.select(*by, "chan", "i_dt", "w", first.alias("first"), F.posexplode(cells).alias("at", "v"))
    return out.select(*by, "chan", "i_dt", "w", (F.col("first") + F.col("at")).cast("int").alias("t"), "v")


def initial_state(wf: DataFrame, plan: TreePlan, by: tuple[str, ...] = (), dense: bool = False) -> DataFrame:
    """*by, i_sub, i_dt, t, v: level 0, the means of each channel."""
    return means(wf, plan, by, dense).select(*by, F.col("chan").alias("i_sub"), "i_dt", "t", "v")


def moved(rows: DataFrame, nsamps: int, dense: bool) -> DataFrame:
    """Cells (t, v) moved by `shift`; what is moved beyond the end goes. dense: a row's first cell also makes the zeros before it."""
    t, shift = F.col("t"), F.col("shift")
    if not dense:
        return rows.withColumn("t", (t + shift).cast("int")).where(t < nsamps)
    rows = rows.withColumn("t", F.explode(F.when(t == 0, F.sequence(F.lit(0), shift)).otherwise(F.array(t + shift))))
    return rows.where(t < nsamps).withColumn("v", F.when(t < shift, 0.0).otherwise(F.col("v")))


def merge_level(state: DataFrame, plan: TreePlan, i: int, by: tuple[str, ...] = (), dense: bool = False) -> DataFrame:
    """State of level i from that of level i - 1: tails, and heads moved by their offset, added up (and so is `channels`, if there)."""
    p = F.broadcast(frames.level(state.sparkSession, plan, i))
    s = state.withColumnsRenamed({"i_sub": "src_sub", "i_dt": "src_dt"}).join(p, ["src_sub", "src_dt"])
    more = [F.sum("channels").alias("channels")] if "channels" in state.columns else []
    return moved(s, plan.geometry.nsamps, dense).groupBy(*by, F.col("out_sub").alias("i_sub"), F.col("out_dt").alias("i_dt"), "t").agg(F.sum("v").alias("v"), *more)


def finished(out: DataFrame, plan: TreePlan, by: tuple[str, ...], dense: bool, absent: str) -> DataFrame:
    """*by, i_dt, dt, dm, t, v of dense sums (*by, i_dt, t, v, channels: of how many)."""
    g, i_dt = plan.geometry, F.col("i_dt")
    if absent == "raise":
        wrong = F.raise_error(F.lit(f"a waterfall of {g.nchans} x {g.nsamps} is needed: a channel is missing")).cast("double")
        out = out.withColumn("v", F.when(F.col("channels") != g.nchans, wrong).otherwise(F.col("v")))
    elif absent != "zero":
        raise ValueError("absent channels raise, or count as zero")
    if not dense:
        out = out.where(F.col("t") >= F.get(F.lit([int(x) for x in plan.lowest()]), i_dt))
    dt = (F.lit(int(plan.dt_grid[0])) + i_dt * g.dt_step).cast("int")
    return out.select(*by, "i_dt", dt.alias("dt"), (dt * F.lit(g.dm_step)).alias("dm"), "t", "v")


def tree_transform(wf: DataFrame, plan: TreePlan, by: tuple[str, ...] = (), dense: bool = True, absent: str = "raise") -> DataFrame:
    """*by, i_dt, dt, dm, t, v by log2(nchans) merges, each row of a band shared by all trials above it.

    Cells that no sample reaches are 0 (dense=False: left out). A cell that is
    missing or repeated raises, and so does a channel without any, unless
    absent="zero"; a key without rows has none.
    """
    state = initial_state(wf, plan, by, True).withColumn("channels", F.lit(1).cast("long"))
    for i in range(1, plan.geometry.niters + 1):
        state = merge_level(state, plan, i, by, True)
    return finished(state.drop("i_sub"), plan, by, dense, absent)


def flat_transform(wf: DataFrame, plan: TreePlan, by: tuple[str, ...] = (), dense: bool = True, absent: str = "raise") -> DataFrame:
    """The same in one join and one sum; for small grids (frames.MOST_FLAT)."""
    p = F.broadcast(frames.flat(wf.sparkSession, plan).select("i_dt", "chan", "w", "shift"))
    x = moved(means(wf, plan, by, True).drop("i_dt").join(p, ["chan", "w"]), plan.geometry.nsamps, True)
    return finished(x.groupBy(*by, "i_dt", "t").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("channels")), plan, by, dense, absent)


def check_waterfall(wf: DataFrame, plan: TreePlan, by: tuple[str, ...] = ()) -> None:
    """Raises unless every channel of each key has each sample once (one aggregation)."""
    g = plan.geometry
    per = wf.groupBy(*by, "chan").agg(F.count("t").alias("n"), F.countDistinct("t").alias("d"), F.min("t").alias("a"), F.max("t").alias("b"))
    odd = (F.col("n") != g.nsamps) | (F.col("d") != g.nsamps) | (F.col("a") != 0) | (F.col("b") != g.nsamps - 1)
    keys = per.groupBy(*by).agg(F.count(F.lit(1)).alias("chans"), F.min("chan").alias("c0"), F.max("chan").alias("c1"), F.sum(odd.cast("int")).alias("odd"))
    good = (F.col("chans") == g.nchans) & (F.col("c0") == 0) & (F.col("c1") == g.nchans - 1) & (F.col("odd") == 0)
    if not keys.agg(F.coalesce(F.bool_and(F.coalesce(good, F.lit(False))), F.lit(False))).first()[0]:
        raise ValueError(f"a waterfall of {g.nchans} x {g.nsamps} is needed")
