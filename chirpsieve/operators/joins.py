"""Joins on time: to the nearest row, of points with intervals, and of intervals with the sums of their points.

None compares all pairs, and none gathers a key's rows in one task:
the nearest join cuts the axis into ranges of about equal numbers of times and
carries the last and first row of a range to the others; the interval join
meets in buckets as wide as the interval is long, and splits the hot ones;
the sums are differences of two running ones, so no pair is made at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16  # of the histogram that ranges are cut by
TIMES = 4096  # distinct times of a range, about
SPLIT = 4096  # points of a bucket that meet in one task, about
BITS = 12  # of a time that one window sorts by: 4,096 rows of a key at most


def _same(a: list[str], b: list[str]) -> Column:
    ok = F.lit(True)
    for x, y in zip(a, b):
        ok = ok & F.col(x).eqNullSafe(F.col(y))
    return ok


def nearest_join(left: DataFrame, right: DataFrame, time: str, pick: str, by: tuple[str, ...] = (), side: str = "nearest", times: int = TIMES) -> DataFrame:
    """left's columns, and of the row of right nearest in time (within a key, if any): `pick` as nearest_<pick>, its time as nearest_<time>.

    side: nearest (of two as near, the later), before (the last not later) or
    after (the first not earlier). Times are numbers; of rows of right at one
    time that of the least pick counts. Null times have no neighbour and are
    none; a null key is a key; rows of left without a neighbour stay, with
    nulls; repeated rows stay repeated. Only distinct times of both sides are
    sorted, so a time that very many rows share is one row.
    """
    if side not in ("nearest", "before", "after"):
        raise ValueError("side is nearest, before or after")
    keys = [f"k{i}_" for i in range(len(by))]
    take = lambda df: df.where(F.col(time).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(time).alias("t_"), *([F.col(pick).alias("p_")] if df is right else []))
    events = take(right).groupBy(*keys, "t_").agg(F.min("p_").alias("p_"), F.lit(True).alias("is_"))
    both = take(left).withColumn("p_", F.lit(None).cast(right.schema[pick].dataType)).withColumn("is_", F.lit(False)).unionByName(events)
    both = both.groupBy(*keys, "t_").agg(F.min("p_").alias("p_"), F.bool_or("is_").alias("is_"))
    low, high, n = both.agg(F.min("t_"), F.max("t_"), F.count(F.lit(1))).first()
    # ranges of about as many times each, from a histogram of CELLS rows at most
    cell = F.least(F.floor((F.col("t_") - low) / F.lit(max(float(high) - float(low), 1e-300)) * CELLS), F.lit(CELLS - 1)).cast("int") if n else F.lit(0)
    both = both.withColumn("cell_", cell)
    counts = both.groupBy("cell_").agg(F.count(F.lit(1)).alias("n_"))
    ranges = counts.select(F.col("cell_").alias("c_"), F.floor((F.sum("n_").over(Window.orderBy("cell_")) - F.col("n_")) / times).cast("int").alias("range_"))
    ranged = both.join(F.broadcast(ranges), F.col("cell_") == F.col("c_")).drop("c_", "cell_")
    event = F.when(F.col("is_"), F.struct("t_", "p_"))
    # both frames run from their beginning to the row at hand: one that runs to the end is made anew for each row
    so_far = lambda *order: Window.partitionBy(*keys, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.select(*keys, "range_", "t_", F.last(event, True).over(so_far("t_")).alias("a_"), F.last(event, True).over(so_far(F.desc("t_"))).alias("b_"))
    # one row for each key and range: the last event before it, the first behind it
    others = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*keys, "range_").agg(F.max("a_").alias("last_"), F.min("b_").alias("first_"))
    names = [f"c{k}" for k in [*keys, "range_"]]
    carried = ends.select(*[F.col(k).alias(c) for k, c in zip([*keys, "range_"], names)], F.last("last_", True).over(others("range_")).alias("before_"), F.last("first_", True).over(others(F.desc("range_"))).alias("behind_"))
    full = ranged.join(carried, _same([*keys, "range_"], names)).select(*keys, "t_", F.coalesce("a_", "before_").alias("a_"), F.coalesce("b_", "behind_").alias("b_"))
    upper = F.col("a_").isNull() | (F.col("b_.t_") - F.col("t_") <= F.col("t_") - F.col("a_.t_"))
    best = {"before": F.col("a_"), "after": F.col("b_"), "nearest": F.when(F.col("b_").isNotNull() & upper, F.col("b_")).otherwise(F.col("a_"))}[side]
    found = full.select(*keys, "t_", best.alias("best_"))
    out = left.join(found, _same(list(by), keys) & (F.col(time) == F.col("t_")), "left")
    return out.select(*[left[c] for c in left.columns], F.col("best_.p_").alias(f"nearest_{pick}"), F.col("best_.t_").alias(f"nearest_{time}"))


def interval_join(points: DataFrame, intervals: DataFrame, time: str, low: str, high: str, by: tuple[str, ...] = (), split: int = SPLIT) -> DataFrame:
    """All pairs of a point and an interval (of the same key, if any) with low <= time <= high; columns of both, keys once.

    Where only counts and sums of an interval's points are asked for, interval_totals makes no pairs.
    An interval lies in one or two buckets of the least power of two that is
    longer than it is; points look into the buckets of every length that
    occurs (64 at most), and each pair meets once. A bucket with more than
    `split` points is dealt over several tasks, to which its intervals go as
    well. Times are whole numbers. Null times, bounds and keys match nothing,
    as do intervals that end before they begin; repeated rows pair each. Apart
    from keys, the two must not share a column name.
    """
    shared = (set(points.columns) & set(intervals.columns)) - set(by)
    if shared:
        raise ValueError(f"both sides have {sorted(shared)}: rename them on one")
    length = F.col(high) - F.col(low)
    iv = intervals.where(F.col(low) <= F.col(high)).withColumn("level_", F.when(length > 0, F.length(F.bin(length))).otherwise(0).cast("int"))
    of = lambda t: F.expr(f"shiftright(cast(`{t}` as bigint), level_)")
    levels = iv.agg(F.sort_array(F.collect_set("level_"))).scalar()  # the lengths that occur
    iv = iv.withColumn("bucket_", F.explode(F.sequence(of(low), of(high))))
    pt = points.where(F.col(time).isNotNull()).withColumn("levels_", levels).withColumn("level_", F.explode("levels_")).drop("levels_").withColumn("bucket_", of(time))
    keys = [*by, "level_", "bucket_"]
    hot = pt.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / split).cast("int").alias("parts_")).where("parts_ > 1")
    pt = pt.join(hot, keys, "left").withColumn("part_", F.when(F.col("parts_").isNull(), 0).otherwise(F.pmod(F.xxhash64(time, F.monotonically_increasing_id()), F.col("parts_")))).drop("parts_")
    iv = iv.join(hot, keys, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    met = pt.withColumn("part_", F.col("part_").cast("int")).join(iv, [*keys, "part_"]).where(F.col(time).between(F.col(low), F.col(high)))
    return met.select(*points.columns, *[c for c in intervals.columns if c not in by])


def _running(rows: DataFrame, keys: list[str], t: str, values: list[str], low: int, high: int, bits: int) -> DataFrame:
    """keys, t, values, and as upto_<value> their sums over all rows of the key that aren't later; a key has each t, of low to high, once.

    A window sorts the rows of one bucket of 2^bits times; a bucket's own sum is
    a row for the same one level up, until one bucket holds all that are left.
    """
    so_far = lambda *by: Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    if high - low < 1 << bits:
        return rows.select(*keys, t, *values, *[F.sum(v).over(so_far(*keys)).alias(f"upto_{v}") for v in values])
    up = f"{t}_up"
    rows = rows.withColumn(up, F.shiftright(t, bits))
    within = rows.select(*keys, up, t, *values, *[F.sum(v).over(so_far(*keys, up)).alias(f"in_{v}") for v in values])
    whole = rows.groupBy(*keys, up).agg(*[F.sum(v).alias(v) for v in values])
    before = _running(whole, keys, up, values, low >> bits, high >> bits, bits)
    before = before.select(*keys, up, *[(F.col(f"upto_{v}") - F.col(v)).alias(f"before_{v}") for v in values])
    return within.join(before, [*keys, up]).select(*keys, t, *values, *[(F.col(f"in_{v}") + F.col(f"before_{v}")).alias(f"upto_{v}") for v in values])


def interval_totals(points: DataFrame, intervals: DataFrame, time: str, low: str, high: str, total: str, by: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """intervals' columns, n and `total`: how many points (of the same key, if any) have low <= time <= high, and the sum of their `total`.

    What interval_join gives, grouped by interval, in work that grows with the
    points and intervals and not with their pairs. Of equal intervals one is
    looked up, of points of one time one is sorted. Those without a point are
    left out. Times and `total` are whole numbers (differences of running sums
    of doubles would be inexact); a sum beyond a long raises. Null totals count
    in n only, and the sum of nothing else is null. Null times, bounds and keys
    match nothing, as do intervals that end before they begin; repeated rows of
    intervals stay repeated.
    """
    odd = [c for df, cs in ((points, (time, total)), (intervals, (low, high))) for c in cs if df.schema[c].dataType.simpleString() not in {"tinyint", "smallint", "int", "bigint"}]
    if odd:
        raise ValueError(f"{odd} are not whole numbers")
    clash = {"n", total, "lo_", "hi_"} & set(intervals.columns)
    if clash:
        raise ValueError(f"{sorted(clash)} are made here: rename them in the intervals")
    keys = [f"k{i}_" for i in range(len(by))]
    named = lambda df: [F.col(c).alias(k) for c, k in zip(by, keys)]
    values = ["n_", "m_", "s_"]
    pt = points.where(F.col(time).isNotNull()).select(*named(points), F.col(time).cast("long").alias("t_"), F.lit(1).cast("long").alias("n_"), F.col(total).isNotNull().cast("long").alias("m_"), F.coalesce(F.col(total), F.lit(0)).cast("decimal(20,0)").alias("s_"))
    pt = pt.dropna(subset=keys) if keys else pt
    first, last = pt.agg(F.min("t_"), F.max("t_")).first()
    first, last = (0, -1) if first is None else (first, last)
    # bounds beyond all points are moved to the outermost ones
    iv = intervals.where(F.col(low) <= F.col(high)).withColumns({"lo_": F.greatest(F.col(low).cast("long"), F.lit(first).cast("long")), "hi_": F.least(F.col(high).cast("long"), F.lit(last).cast("long"))}).where("lo_ <= hi_")
    asked = iv.select(*named(iv), "lo_", "hi_").distinct()
    asked = asked.dropna(subset=keys) if keys else asked
    bounds = asked.select(*keys, F.explode(F.array("lo_", "hi_")).alias("t_"), F.lit(0).cast("long").alias("n_"), F.lit(0).cast("long").alias("m_"), F.lit(0).cast("decimal(20,0)").alias("s_"))
    marks = pt.unionByName(bounds).groupBy(*keys, "t_").agg(*[F.sum(v).alias(v) for v in values])
    marks = _running(marks, keys, "t_", values, first, last, bits)
    begin = marks.select(*keys, F.col("t_").alias("lo_"), *[(F.col(f"upto_{v}") - F.col(v)).alias(f"a{v}") for v in values])
    end = marks.select(*keys, F.col("t_").alias("hi_"), *[F.col(f"upto_{v}").alias(f"b{v}") for v in values])
    n, m, s = (F.col(f"b{v}") - F.col(f"a{v}") for v in values)
    found = asked.join(begin, [*keys, "lo_"]).join(end, [*keys, "hi_"]).where(n > 0)
    found = found.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "lo_", "hi_", n.alias("n"), F.when(m > 0, s).cast("long").alias(total))
    return iv.join(found, [*by, "lo_", "hi_"]).select(*intervals.columns, "n", total)
