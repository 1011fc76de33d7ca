"""Array-in, array-out classes for those who hold a waterfall in memory, beside the DataFrame operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, direct
from .plans import frames
from .plans.geometry import SIMULATOR_DISPERSION, DirectGeometry, Geometry
from .plans.tree import TreePlan


class TreeTransform:
    """execute() and initialise() take a (channel, sample) array, or a packed DataFrame to run on the cluster."""

    def __init__(self, f_min, f_max, nchans, nsamps, tsamp, dt_max, dt_step=1, dt_min=0, **more):
        self.geometry = Geometry(f_min, f_max, nchans, nsamps, tsamp, dt_max, dt_step, dt_min, **more)
        self.plan = TreePlan(self.geometry)

    df = property(lambda self: self.geometry.df)
    correction = property(lambda self: self.geometry.correction)
    niters = property(lambda self: self.geometry.niters)
    dt_grid_final = property(lambda self: self.plan.dt_grid)
    dm_grid_final = property(lambda self: self.plan.dm_grid)

    def plan_frame(self, spark: SparkSession) -> DataFrame:
        return frames.mappings(spark, self.plan)

    def execute(self, waterfall, length: int | None = None):
        if isinstance(waterfall, DataFrame):
            return blocks.tree_blocks(waterfall, self.plan, length or self.geometry.nsamps)
        return blocks.transform_matrix(np.asarray(waterfall, dtype=np.float32), self.plan)

    def initialise(self, waterfall) -> np.ndarray:
        x = np.asarray(waterfall, dtype=np.float32)
        if x.shape != (self.geometry.nchans, self.geometry.nsamps):
            raise ValueError("the waterfall doesn't have the geometry's shape")
        return blocks.channel_means(x, self.plan)


class DirectTransform:
    """A direct sum over channels, for a range of DMs or an explicit list."""

    def __init__(self, f_min, f_max, nchans, tsamp, dm_max=None, dm_step=None, dm_min=0.0, dms=None, **more):
        if dms is not None:
            self.geometry = DirectGeometry(f_min, f_max, nchans, tsamp, tuple(float(x) for x in dms), **more)
        else:
            self.geometry = DirectGeometry.from_range(f_min, f_max, nchans, tsamp, dm_max, dm_step, dm_min, **more)

    dm_grid = property(lambda self: np.array(self.geometry.dms))
    delays = property(lambda self: self.geometry.delays())

    def execute(self, waterfall, length: int | None = None, masked: tuple[int, ...] = ()):
        """Samples of masked channels count as zeros. length: samples of a block of a DataFrame, its longest row's if not given."""
        if isinstance(waterfall, DataFrame):
            length = length or waterfall.agg(F.max(F.size("x"))).first()[0] or 1
            return blocks.direct_blocks(waterfall, self.geometry, length, masked=masked)
        return direct.direct_matrix(np.asarray(waterfall, dtype=np.float32), self.geometry, masked)


def generate_pulse(f_min, f_max, nchans, nsamps, tsamp, dm, amp=1.0, offset=0, width=1, noise_rms=0.0, seed=0) -> np.ndarray:
    """A (channel, sample) array of a dispersed boxcar in seeded noise; pulse.simulate_pulse makes it as a DataFrame."""
    f = f_min + np.arange(nchans) * ((f_max - f_min) / nchans)
    shift = np.rint(SIMULATOR_DISPERSION * dm * (f_min**-2.0 - f**-2.0) / tsamp).astype(np.int64)
    source = (np.arange(nsamps) + shift[:, None]) % nsamps
    x = np.where((source >= offset) & (source < offset + width), float(amp), 0.0)
    return (x + np.random.default_rng(seed).normal(0, noise_rms, x.shape) if noise_rms else x).astype(np.float32)


def set_log_level(spark: SparkSession, level: str) -> None:
    spark.sparkContext.setLogLevel(level)


def set_num_partitions(spark: SparkSession, n: int) -> None:
    """Parallelism of shuffles; that of tasks is the cluster's."""
    spark.conf.set("spark.sql.shuffle.partitions", str(int(n)))
