"""The tree transform of packed recordings as a table function of SQL.

    select * from tree(table(select obs, block, chan, x from recording) partition by obs order by block,
                       f_min => 1000, f_max => 1500, nchans => 8, tsamp => 0.001, dt_max => 16, length => 24)

Blocks of an observation come in order; what is held is one block and the halo
before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..plans.geometry import Geometry
from ..plans.tree import TreePlan
from .blocks import channel_means, run_levels

NEEDED = ("obs", "block", "chan", "x")


def _geometry(f_min, f_max, nchans, tsamp, dt_max, length) -> Geometry:
    # offsets may reach over several blocks: nsamps only bounds them
    return Geometry(float(f_min), float(f_max), int(nchans), max(int(length), int(dt_max) + 1), float(tsamp), int(dt_max))


class Tree:
    """obs, block, i_dt, dt, dm, v of rows (obs, block, chan, x), partitioned by obs and ordered by block.

    Channels that a block lacks count as zeros, and a missing block ends what is
    known before the next one, which ramps up anew; a channel twice in a block,
    or null numbers, raise.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, f_min: AnalyzeArgument, f_max: AnalyzeArgument, nchans: AnalyzeArgument, tsamp: AnalyzeArgument, dt_max: AnalyzeArgument, length: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or any(c not in rows.dataType.names for c in NEEDED):
            raise ValueError(f"tree() needs a table with columns {', '.join(NEEDED)}")
        values = [x.value for x in (f_min, f_max, nchans, tsamp, dt_max, length)]
        if None in values:
            raise ValueError("the geometry of tree() must be constants")
        _geometry(*values)
        obs = rows.dataType["obs"].dataType
        schema = StructType().add("obs", obs).add("block", LongType()).add("i_dt", IntegerType()).add("dt", IntegerType()).add("dm", DoubleType()).add("v", ArrayType(DoubleType()))
        return AnalyzeResult(schema)

    def __init__(self):
        self.plan, self.now, self.held, self.obs = None, None, {}, None

    def eval(self, row: Row, f_min, f_max, nchans, tsamp, dt_max, length):
        if self.plan is None:
            self.length, self.obs = int(length), row["obs"]
            self.plan = TreePlan(_geometry(f_min, f_max, nchans, tsamp, dt_max, length))
            self.past = np.zeros((self.plan.geometry.nchans, 0))
        if self.now is not None and row["block"] != self.now:
            yield from self._close(row["block"])
        self.now, c, x = row["block"], row["chan"], np.asarray(row["x"], dtype=np.float64)
        if c in self.held or not 0 <= c < self.plan.geometry.nchans or len(x) > self.length:
            raise ValueError(f"block {self.now}: channels 0 to {self.plan.geometry.nchans - 1}, once each, of {self.length} samples at most, are needed")
        self.held[c] = x

    def terminate(self):
        if self.now is not None:
            yield from self._close(None)

    def _close(self, following: int | None):
        p, n = self.plan, max(map(len, self.held.values()))
        own = np.zeros((p.geometry.nchans, n))
        for c, x in self.held.items():
            own[c, : len(x)] = x
        m = np.concatenate([self.past, own], axis=1)
        v = run_levels(channel_means(m, p), p)[:, m.shape[1] - n :]
        for i, (dt, dm) in enumerate(zip(p.dt_grid.tolist(), p.dm_grid.tolist())):
            yield self.obs, self.now, i, dt, dm, v[i].tolist()
        follows = following == self.now + 1 and n == self.length
        self.past, self.held = m[:, max(0, m.shape[1] - p.halo()) :] if follows else m[:, :0], {}


def register(spark: SparkSession, name: str = "tree") -> None:
    """Makes tree(...) callable from the session's SQL."""
    spark.udtf.register(name, udtf(Tree, useArrow=True))
