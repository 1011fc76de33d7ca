"""The transforms over packed waterfalls, block by block: the path for long recordings.

A recording is rows (chan, block, x array<float>), each with `length` samples of
one channel. A block's output needs `halo` samples before it, so each row sends
its tail to the next block, blocks are shuffled once by their number, and numpy
runs all levels of a block in one task. Work and memory of a task depend on the
geometry and `length` alone, whatever the length of the recording.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.geometry import DirectGeometry
from ..plans.tree import TreePlan
from ..sources.recording import read_recording


def channel_means(x: np.ndarray, plan: TreePlan) -> np.ndarray:
    """Level 0 of a (channel, sample) matrix: rows (channel, w), 0 where fewer than w + 1 samples exist.

    Sums are kept in float64, so float32 inputs lose nothing; they are made of
    one channel at a time, and only of those that are averaged at all.
    """
    base, n = plan.levels[0], x.shape[1]
    out = np.empty((len(base.delay), n), dtype=x.dtype)
    sums, part, of = np.zeros(n + 1), np.empty(n), -1
    for row, (w, c) in enumerate(zip(base.delay.tolist(), base.band.tolist())):
        if w == 0:
            out[row] = x[c]
            continue
        out[row, :w] = 0
        if w < n:
            if c != of:
                np.cumsum(x[c], out=sums[1:], dtype=np.float64)
                of = c
            np.subtract(sums[w + 1 :], sums[: n - w], out=part[: n - w])
            np.divide(part[: n - w], w + 1, out=out[row, w:], casting="unsafe")
    return out


def run_levels(state: np.ndarray, plan: TreePlan, upto: int | None = None) -> np.ndarray:
    """All merges (or the first `upto`) of one block in memory, row by row into the next level.

    Two buffers take turns, so that no level touches new memory. A row's sources
    are read as they lie: gathers of all rows of one offset copy both, and took
    3.5 times as long (README).
    """
    n = state.shape[1]
    turns = [np.empty((max(len(x.tail) for x in plan.levels[k::2]), n), dtype=state.dtype) if len(plan.levels) > k else None for k in (1, 2)]
    for i, level in enumerate(plan.levels[1 : None if upto is None else upto + 1]):
        out = turns[i % 2][: len(level.tail)]
        for row, (tail, head, off) in enumerate(zip(level.tail.tolist(), level.head.tolist(), level.offset.tolist())):
            if head < 0 or off >= n:
                out[row] = state[tail]
            else:
                out[row, :off] = state[tail, :off]
                np.add(state[tail, off:], state[head, : n - off], out=out[row, off:])
        state = out
    return state


def transform_matrix(x: np.ndarray, plan: TreePlan) -> np.ndarray:
    """(trial, sample) from a whole (channel, sample) matrix."""
    if x.ndim != 2 or x.shape != (plan.geometry.nchans, plan.geometry.nsamps):
        raise ValueError(f"a waterfall of {plan.geometry.nchans} x {plan.geometry.nsamps} is needed, not {x.shape}")
    return run_levels(channel_means(x, plan), plan)


def with_halo(packed: DataFrame, halo: int, length: int, nchans: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Each row once for its own block, and its tail again for the blocks that need it (lag 0, 1, ...); one scan.

    A channel that isn't the geometry's, or a row longer than a block, raises.
    """
    parts = [F.struct(F.col("block"), F.col("x"), F.lit(0).alias("lag"))]
    for k in range(1, -(-halo // length) + 1):
        keep = min(length, halo - (k - 1) * length)
        tail = F.slice("x", F.greatest(F.lit(1), F.size("x") - keep + 1), F.lit(keep))
        parts.append(F.struct((F.col("block") + k).alias("block"), tail.alias("x"), F.lit(k).alias("lag")))
    fits = F.coalesce(F.col("chan").between(0, nchans - 1) & (F.size("x") <= length), F.lit(False))
    wrong = F.raise_error(F.lit(f"channels 0 to {nchans - 1} in blocks of {length} samples at most are needed")).cast("boolean")
    packed = packed.where(F.when(fits, True).otherwise(wrong))
    return packed.select(*by, "chan", F.explode(F.array(*parts)).alias("part")).select(*by, "chan", "part.block", "part.x", "part.lag")


def _matrix(table: pa.Table, nchans: int, halo: int, length: int, real, absent: str) -> tuple[np.ndarray, int, int] | None:
    """A block's samples behind those before it: the matrix, the block's own length, and how many samples before it exist."""
    chan, lag, lists = table["chan"].to_numpy(), table["lag"].to_numpy(), table["x"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    if pa.types.is_binary(lists.type):  # float32 samples as they lie in memory
        lists = pa.concat_arrays([lists])  # from its first byte
        ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] // 4
        values = np.frombuffer(lists.buffers()[2], np.float32)
    else:
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    own = np.flatnonzero(lag == 0)
    if not len(own):
        return None  # only the tail of the last block came here
    mine = np.bincount(chan[own], minlength=nchans)
    if mine.max() > 1 or absent == "raise" and (mine.min() < 1 or len(set((ends[1:] - ends[:-1])[own].tolist())) > 1):
        raise ValueError(f"a block needs each of {nchans} channels once, all of one length")
    n = int((ends[1:] - ends[:-1])[own].max())
    m, known = np.zeros((nchans, halo + n), dtype=real), 0
    for c, k, a, b in zip(chan.tolist(), lag.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        if k == 0:
            m[c, halo : halo + b - a] = values[a:b]
        else:
            end = halo - (k - 1) * length
            m[c, end - (b - a) : end] = values[a:b]
            known = max(known, halo - (end - (b - a)))
    return m, n, known


def _lists(v: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list array, without a copy of each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(np.ascontiguousarray(v).reshape(-1)))


def _answer(table: pa.Table, by: tuple[str, ...], rows: int, columns: dict) -> pa.Table:
    same = {c: pa.concat_arrays([table[c].combine_chunks().slice(0, 1)] * rows) if rows else table[c].combine_chunks().slice(0, 0) for c in (*by, "block")}
    return pa.table(same | columns)


def _schema(packed: DataFrame, by: tuple[str, ...], more: str) -> str:
    return ", ".join([*(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in (*by, "block")), more])


def _tree_of(plan: TreePlan, length: int, absent: str):
    """A function from a block's table (keys, block, chan, lag, x) to the table of its trials."""
    if absent not in ("raise", "zero"):
        raise ValueError("absent channels raise, or count as zero")
    halo, nchans, trials, dms = plan.halo(), plan.geometry.nchans, plan.dt_grid.astype(np.int32), plan.dm_grid
    real = np.float32 if plan.geometry.precision == "float32" else np.float64

    def run(table: pa.Table, by: tuple[str, ...]) -> pa.Table:
        got = _matrix(table, nchans, halo, length, real, absent)
        rows, v = (len(trials), None) if got else (0, np.zeros((0, 1), real))
        if got:
            m, n, known = got
            m = m[:, halo - known :]
            v = run_levels(channel_means(m, plan), plan)[:, m.shape[1] - n :]
        return _answer(table, by, rows, {"i_dt": pa.array(np.arange(rows, dtype=np.int32)), "dt": pa.array(trials[:rows]), "dm": pa.array(dms[:rows]), "v": _lists(v)})

    return run, f"i_dt int, dt int, dm double, v array<{'float' if real is np.float32 else 'double'}>"


def tree_blocks(packed: DataFrame, plan: TreePlan, length: int, by: tuple[str, ...] = (), absent: str = "raise") -> DataFrame:
    """*by, block, i_dt, dt, dm, v (an array of the geometry's precision): the tree transform of a recording of any length.

    The first block ramps up from zero samples, as one matrix would. A block
    with a channel twice raises, and so does one without a channel, or with
    rows of several lengths, unless absent="zero".
    """
    run, columns = _tree_of(plan, length, absent)
    rows = with_halo(packed, plan.halo(), length, plan.geometry.nchans, by)
    return rows.groupBy(*by, "block").applyInArrow(lambda table: run(table, by), _schema(packed, by, columns))


def tree_recording(spark: SparkSession, path: str, plan: TreePlan, length: int, absent: str = "raise") -> DataFrame:
    """obs, block, i_dt, dt, dm, v: the same of a recording as sources.recording has it, whose blocks have `length` samples; nothing is shuffled."""
    run, columns = _tree_of(plan, length, absent)

    def blocks(batches):
        held, key = [], None
        for batch in batches:  # a task has whole blocks, one after the other; a batch may hold parts of several
            o, b = batch["obs"].to_numpy(), batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(o) != 0) | (np.diff(b) != 0)) + 1).tolist(), len(o)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and (o[i], b[i]) != key:
                    yield from run(pa.Table.from_batches(held), ("obs",)).to_batches()
                    held = []
                key = (o[i], b[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from run(pa.Table.from_batches(held), ("obs",)).to_batches()

    return read_recording(spark, path, plan.halo(), True).mapInArrow(blocks, f"obs long, block long, {columns}")


def level_blocks(packed: DataFrame, plan: TreePlan, level: int, length: int, by: tuple[str, ...] = (), absent: str = "raise") -> DataFrame:
    """*by, block, i_sub, i_dt, v: the state after `level` merges (0: means) of packed rows, 0 where nothing has come yet."""
    if not 0 <= level < len(plan.levels):
        raise ValueError(f"levels are 0 to {len(plan.levels) - 1}")
    halo, nchans, real = plan.halo(), plan.geometry.nchans, np.float32 if plan.geometry.precision == "float32" else np.float64
    band, index = plan.levels[level].band.astype(np.int32), plan.levels[level].index.astype(np.int32)

    def run(table: pa.Table) -> pa.Table:
        got = _matrix(table, nchans, halo, length, real, absent)
        rows, v = (len(band), None) if got else (0, np.zeros((0, 1), real))
        if got:
            m, n, known = got
            m = m[:, halo - known :]
            v = run_levels(channel_means(m, plan), plan, level)[:, m.shape[1] - n :]
        return _answer(table, by, rows, {"i_sub": pa.array(band[:rows]), "i_dt": pa.array(index[:rows]), "v": _lists(v)})

    columns = f"i_sub int, i_dt int, v array<{'float' if real is np.float32 else 'double'}>"
    return with_halo(packed, halo, length, nchans, by).groupBy(*by, "block").applyInArrow(run, _schema(packed, by, columns))


def direct_blocks(packed: DataFrame, g: DirectGeometry, length: int, by: tuple[str, ...] = (), masked: tuple[int, ...] = (), absent: str = "raise") -> DataFrame:
    """*by, block, i_dm, dm, first, v array<double>: the direct transform, `first` being the block-relative sample of v[0].

    Cells that would need samples before the recording are left out, as in one
    matrix; masked channels count as zeros, and with absent="zero" so do those
    that a block lacks.
    """
    d = g.delays()
    halo = int(np.abs(d).max())
    if (d > 0).any():
        raise ValueError("blocks look back only: DMs must not be negative")
    dms, used = np.array(g.dms), [c for c in range(g.nchans) if c not in masked]

    def run(table: pa.Table) -> pa.Table:
        got = _matrix(table, g.nchans, halo, length, np.float64, absent)
        rows, skip, v = 0, 0, np.zeros((0, 1))
        if got:
            m, n, known = got
            skip, rows = min(n, max(0, halo - known)), len(dms)
            v = np.zeros((rows, n - skip))
            for i in range(rows):
                for c in used:
                    at = halo + skip + d[i, c]
                    v[i] += m[c, at : at + n - skip]
        return _answer(table, by, rows, {"i_dm": pa.array(np.arange(rows, dtype=np.int32)), "dm": pa.array(dms[:rows]), "first": pa.array(np.full(rows, skip, np.int32)), "v": _lists(v)})

    return with_halo(packed, halo, length, g.nchans, by).groupBy(*by, "block").applyInArrow(run, _schema(packed, by, "i_dm int, dm double, first int, v array<double>"))
