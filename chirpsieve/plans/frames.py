"""Plans as small DataFrames, to be broadcast to the data (their size is that of the geometry, not of the data)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .geometry import DirectGeometry
from .tree import TreePlan

# A flat plan has ndt x nchans rows; beyond this many the tree is the only form offered.
MOST_FLAT = 2_000_000


def _frame(spark: SparkSession, columns: dict, schema: str) -> DataFrame:
    """From Arrow: a relation that the driver holds, so broadcasting it needs no job."""
    kinds = {"int": pa.int32(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return spark.createDataFrame(pa.table({n: pa.array(columns[n], kinds[k]) for n, k in fields}), schema)


def _small(plan: TreePlan) -> None:
    if plan.cost()[1] > MOST_FLAT:
        raise ValueError(f"the flat form of this geometry has {plan.cost()[1]} rows; use the tree")


def flat(spark: SparkSession, plan: TreePlan) -> DataFrame:
    _small(plan)
    return _frame(spark, plan.flatten(), "i_dt int, dt int, chan int, w int, shift int")


def level(spark: SparkSession, plan: TreePlan, i: int) -> DataFrame:
    """Lineage of level i: a row for each source (tail, and head unless copied) of each of its rows."""
    this, below = plan.levels[i], plan.levels[i - 1]
    up = this.head >= 0
    row = np.concatenate([np.arange(len(this.tail)), np.flatnonzero(up)])
    src = np.concatenate([this.tail, this.head[up]])
    shift = np.concatenate([np.zeros(len(this.tail), dtype=np.int64), this.offset[up]])
    return _frame(spark, {"out_sub": this.band[row], "out_dt": this.index[row], "src_sub": below.band[src], "src_dt": below.index[src], "shift": shift}, "out_sub int, out_dt int, src_sub int, src_dt int, shift int")


def _packed(spark: SparkSession, name: str, value: list, kind: pa.DataType) -> DataFrame:
    """One row of one column: a plan that each block reads whole."""
    return spark.createDataFrame(pa.table({name: pa.array([value], kind)}))


def _rows(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.int32()) for n in names]))


def packed_channels(spark: SparkSession, plan: TreePlan) -> DataFrame:
    """channels: (chan, w) of each row of level 0."""
    x = plan.levels[0]
    return _packed(spark, "channels", [{"chan": c, "w": w} for c, w in zip(x.band.tolist(), x.delay.tolist())], _rows("chan", "w"))


def packed_levels(spark: SparkSession, plan: TreePlan) -> DataFrame:
    """levels: of each from 1 on, (tail, head, shift) of each row: row numbers of the level below, head -1 where it is copied."""
    levels = [[{"tail": a, "head": b, "shift": c} for a, b, c in zip(x.tail.tolist(), x.head.tolist(), x.offset.tolist())] for x in plan.levels[1:]]
    return _packed(spark, "levels", levels, pa.list_(_rows("tail", "head", "shift")))


def packed_flat(spark: SparkSession, plan: TreePlan) -> DataFrame:
    """trials: of each, (row of level 0, shift) of its channels."""
    _small(plan)
    f, x = plan.flatten(), plan.levels[0]
    row = {k: i for i, k in enumerate(zip(x.band.tolist(), x.delay.tolist()))}
    trials = [[] for _ in plan.final.delay]
    for i, c, w, shift in zip(*(f[k].tolist() for k in ("i_dt", "chan", "w", "shift"))):
        trials[i].append({"row": row[c, w], "shift": shift})
    return _packed(spark, "trials", trials, pa.list_(_rows("row", "shift")))


def mappings(spark: SparkSession, plan: TreePlan) -> DataFrame:
    """The plan itself: level, i_sub, i_dt, dt and the coordinates of tail and head (null: none) with the head's offset."""
    out = []
    for i, x in enumerate(plan.levels):
        below = plan.levels[i - 1] if i else None
        pick = lambda rows, k: pd.array(np.where(rows >= 0, getattr(below, k)[rows], 0) if below is not None else rows, dtype="Int32")
        part = pd.DataFrame({"level": i, "i_sub": x.band, "i_dt": x.index, "dt": x.delay})
        for name, rows in (("tail", x.tail), ("head", x.head)):
            for col, k in ((f"{name}_sub", "band"), (f"{name}_dt", "index")):
                part[col] = pick(rows, k)
                part.loc[rows < 0, col] = pd.NA
        part["offset"] = pd.array(x.offset, dtype="Int32")
        part.loc[x.tail < 0, "offset"] = pd.NA
        out.append(part)
    rows = [tuple(None if pd.isna(v) else int(v) for v in r) for r in pd.concat(out).itertuples(index=False)]
    return spark.createDataFrame(rows, "level int, i_sub int, i_dt int, dt int, tail_sub int, tail_dt int, head_sub int, head_dt int, offset int")


def channels(spark: SparkSession, plan: TreePlan) -> DataFrame:
    """chan, i_dt, w of level 0."""
    x = plan.levels[0]
    return _frame(spark, {"chan": x.band, "i_dt": x.index, "w": x.delay}, "chan int, i_dt int, w int")


def trials(spark: SparkSession, plan: TreePlan) -> DataFrame:
    x = plan.final
    return _frame(spark, {"i_dt": x.index, "dt": x.delay, "dm": plan.dm_grid}, "i_dt int, dt int, dm double")


def delays(spark: SparkSession, g: DirectGeometry) -> DataFrame:
    """i_dm, dm, chan, delay (signed samples)."""
    d = g.delays()
    i, c = np.indices(d.shape)
    return _frame(spark, {"i_dm": i.ravel(), "dm": np.array(g.dms)[i.ravel()], "chan": c.ravel(), "delay": d.ravel()}, "i_dm int, dm double, chan int, delay int")
