"""The tree transform of an endless recording: state is the last `halo` samples of each channel.

A block is a row (obs, block, x array<array<float>>) with all channels of
`length` samples. Blocks of an observation may arrive in any order within the
kept look-ahead; each is transformed as soon as all before it have been.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.blocks import channel_means, run_levels
from ..plans.tree import TreePlan


def tree_stream(blocks: DataFrame, plan: TreePlan, look_ahead: int = 64) -> DataFrame:
    """obs, block, i_dt, dt, v of a stream of (obs string, block long, x array<array<float>>), starting at block 0.

    State: the next block's number, the halo, and at most `look_ahead` blocks
    that came early: a block farther ahead raises, for one before it is lost. A
    block that came before is ignored (a source may repeat it).
    """
    halo, trials, nchans = plan.halo(), plan.dt_grid, plan.geometry.nchans

    def run(key, parts, state):
        at, width, past, early = state.get if state.exists else (0, 0, b"", [])
        past = np.frombuffer(past, np.float32).reshape(nchans, width) if width else np.zeros((nchans, 0), np.float32)
        waiting = {int(b): np.frombuffer(x, np.float32).reshape(nchans, -1) for b, x in early}
        for pdf in parts:
            for b, x in zip(pdf.block, pdf.x):
                if b > at + look_ahead:
                    raise ValueError(f"block {b} of {key[0]} came while {at} was missing")
                if b >= at:
                    waiting.setdefault(int(b), np.stack([np.asarray(r, dtype=np.float32) for r in x]))
        out = []
        while at in waiting:
            x = waiting.pop(at)
            m = np.concatenate([past, x], axis=1)
            v = run_levels(channel_means(m, plan), plan)[:, m.shape[1] - x.shape[1] :]
            out.append(pd.DataFrame({"obs": key[0], "block": at, "i_dt": np.arange(len(trials)), "dt": trials, "v": list(v.astype(np.float32))}))
            past, at = m[:, max(0, m.shape[1] - halo) :], at + 1
        state.update((at, past.shape[1], np.ascontiguousarray(past).tobytes(), [(b, np.ascontiguousarray(x).tobytes()) for b, x in sorted(waiting.items())]))
        yield from out

    return blocks.groupBy("obs").applyInPandasWithState(run, "obs string, block long, i_dt int, dt int, v array<float>", "at long, width int, past binary, early array<struct<b:bigint,x:binary>>", "append", GroupStateTimeout.NoTimeout)
