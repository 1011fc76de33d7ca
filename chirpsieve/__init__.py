"""Dispersed-pulse search over radio time-frequency data, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .api import DirectTransform, TreeTransform, generate_pulse, set_log_level, set_num_partitions  # noqa: E402

__all__ = ["DirectTransform", "TreeTransform", "generate_pulse", "set_log_level", "set_num_partitions"]
