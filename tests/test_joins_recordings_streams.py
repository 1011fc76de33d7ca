"""Time joins, top cells, recordings as a data source, the table function and the timed stream, against brute force."""

import datetime
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpsieve.operators import blocks, joins, pulse, table_function
from chirpsieve.plans.geometry import Geometry
from chirpsieve.plans.tree import TreePlan
from chirpsieve.sources import recording
from chirpsieve.streaming import timed


def some(seed, n, span, ids=True):
    r = np.random.default_rng(seed)
    # one time holds a third of all rows; there are repeated rows, null times and null keys
    t = [None if r.random() < 0.03 else 50 if r.random() < 0.33 else int(r.integers(0, span)) for _ in range(n)]
    k = [None if r.random() < 0.05 else "ab"[int(r.random() < 0.2)] for _ in range(n)]
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(k, t))]
    return rows + rows[:5]


@pytest.mark.parametrize("side", ["nearest", "before", "after"])
@pytest.mark.parametrize(("by", "times"), [((), 4096), (("k",), 3), ((), 1)])
def test_nearest_join(spark, side, by, times):
    left, right = some(1, 120, 1000), some(2, 60, 900)
    a = spark.createDataFrame(left, "id long, k string, t long").repartition(3)
    b = spark.createDataFrame(right, "event long, k string, t long").repartition(2)
    got = joins.nearest_join(a, b, "t", "event", by, side, times)
    assert got.columns == ["id", "k", "t", "nearest_event", "nearest_t"]
    want = []
    for i, k, t in left:
        best = None
        for e, kk, u in right:
            if t is None or u is None or by and k != kk or side == "before" and u > t or side == "after" and u < t:
                continue
            cand = (abs(u - t), -u, e)
            best = min(best, (cand, e, u)) if best else (cand, e, u)
        want.append((i, k, t, *(best[1:] if best else (None, None))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert joins.nearest_join(a.limit(0), b, "t", "event", by, side).count() == 0
    assert joins.nearest_join(a, b.limit(0), "t", "event", by, side).where("nearest_event is not null").count() == 0


@pytest.mark.parametrize(("by", "split"), [((), 4096), (("k",), 2)])
def test_interval_join(spark, by, split):
    r = np.random.default_rng(4)
    points = some(5, 90, 600)
    ivs = [(i, "ab"[i % 2], None if i == 3 else int(a), None if i == 4 else int(a + w)) for i, (a, w) in enumerate(zip(r.integers(-50, 600, 70), [0, 1, 2, 7, 8, 9, 500, -3, 63, 64] * 7))]
    p = spark.createDataFrame(points, "id long, k string, t long").repartition(3)
    i = spark.createDataFrame(ivs + ivs[:2], "iv long, k string, lo long, hi long")
    i = i if by else i.drop("k")
    got = joins.interval_join(p, i, "t", "lo", "hi", by, split)
    want = [(a, k, t, iv, lo, hi) for a, k, t in points for iv, kk, lo, hi in ivs + ivs[:2] if None not in (t, lo, hi) and lo <= t <= hi and (not by or k == kk)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        joins.interval_join(p, i.withColumn("id", F.lit(1)), "t", "lo", "hi", by)


@pytest.mark.parametrize(("by", "bits"), [((), 12), (("k",), 2), (("k",), 5)])
def test_interval_totals(spark, by, bits):
    r = np.random.default_rng(6)
    # running sums leave a long, an interval's own don't; some totals are null
    points = [(k, None if t is None else t - 200, None if i % 7 == 0 else (1 << 60) + i) for i, k, t in some(7, 90, 600)]
    ivs = [(i, "ab"[i % 2] if i % 9 else None, None if i == 3 else int(a), None if i == 4 else int(a + w)) for i, (a, w) in enumerate(zip(r.integers(-300, 600, 70), [0, 1, 2, 7, 8, 9, 10, -3, 6, 5] * 7))]
    ivs = [(i, k, lo, hi) for i, k, lo, hi in ivs if None in (lo, hi) or not lo <= -150 <= hi] + [(90, "a", -10_000, -200), (91, "b", 399, 1 << 62)]
    p = spark.createDataFrame(points, "k string, t long, x long").repartition(3)
    i = spark.createDataFrame(ivs + ivs[:2], "iv long, k string, lo long, hi long")
    want = []
    for iv, k, lo, hi in ivs + ivs[:2]:
        held = [x for kk, t, x in points if None not in (t, lo, hi) and lo <= t <= hi and (not by or k is not None and k == kk)]
        if held:
            some_ = [x for x in held if x is not None]
            want.append((iv, k, lo, hi, len(held), sum(some_) if some_ else None))
    got = joins.interval_totals(p, i, "t", "lo", "hi", "x", by, bits)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
    assert joins.interval_totals(p.limit(0), i, "t", "lo", "hi", "x", by, bits).count() == 0
    assert joins.interval_totals(p, i.limit(0), "t", "lo", "hi", "x", by, bits).count() == 0
    with pytest.raises(ValueError, match="whole"):
        joins.interval_totals(p.withColumn("x", F.lit(0.5)), i, "t", "lo", "hi", "x", by)
    with pytest.raises(ValueError, match="rename"):
        joins.interval_totals(p, i.withColumn("n", F.lit(1)), "t", "lo", "hi", "x", by)


def test_shipping_windows_makes_no_pairs(spark, tmp_path):
    """40,000 lines that hold each of 40,000 events: 1.6 billion pairs."""
    import time

    import __spark_entry__ as entry

    n = 40_000
    spark.range(n).selectExpr("id as l_orderkey", "1 as l_linenumber", "500 * id as l_partkey", "24.0D as l_quantity", "timestamp'1990-01-01 00:00:00' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).selectExpr("id as event_id", "500 * id as user_id", "0.01D * id as value", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts").write.parquet(f"{tmp_path}/events.parquet")
    begun = time.time()
    got = entry.queries()["shipping_windows"](spark, str(tmp_path)).groupBy("n", "cents").count().collect()
    assert [tuple(r) for r in got] == [(n, n * (n - 1) // 2, n)]
    assert time.time() - begun < 60


def test_best_cells_of_each_key(spark):
    rows = [(o, i, t, None if (i + t) % 7 == 0 else float((i * t + o) % 5)) for o in range(3) for i in range(6) for t in range(8)] + [(9, 0, 0, None), (8, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "obs int, i_dt int, t int, v double")
    got = pulse.peak(df, k=5, by=("obs",))
    want = []
    for o in {r[0] for r in rows}:
        cells = sorted((-v, i, t) for oo, i, t, v in rows if oo == o and v is not None)[:5]
        want += [(o, i, t, -v, n + 1) for n, (v, i, t) in enumerate(cells)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and behind the shuffle


# ---- recordings ---------------------------------------------------------------

G = Geometry(1000, 1500, 4, 64, 0.001, 20)


def packed(spark, x, length, obs=0):
    return spark.createDataFrame([(obs, b, c, [float(v) for v in x[c, b * length : (b + 1) * length]]) for c in range(len(x)) for b in range(-(-x.shape[1] // length))], "obs long, block long, chan int, x array<float>")


@pytest.mark.parametrize("length", [5, 16, 64])
def test_recording_transform_is_that_of_one_matrix(spark, tmp_path, length):
    p, r = TreePlan(G), np.random.default_rng(1)
    xs = [r.random((4, 64)).astype(np.float32) for _ in range(3)]
    path = f"file://{tmp_path}/rec"
    recording.write_recording(packed(spark, xs[0], length).union(packed(spark, xs[1], length, 7)), path, slice=3)
    recording.write_recording(packed(spark, xs[2], length, 8), path, mode="append", slice=64)
    out = blocks.tree_recording(spark, path, p, length)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {o: np.zeros((21, 64)) for o in (0, 7, 8)}
    for row in out.collect():
        got[row.obs][row.i_dt, row.block * length : (row.block + 1) * length] = row.v
    for o, x in zip((0, 7, 8), xs):
        np.testing.assert_allclose(got[o], blocks.transform_matrix(x.astype(np.float64), p), atol=1e-4)


def test_recording_reads_what_is_asked_for(spark, tmp_path):
    x, path = np.arange(160, dtype=np.float32).reshape(4, 40), f"file://{tmp_path}/rec"
    recording.write_recording(packed(spark, x, 8), path, slice=4)
    one = recording.read_recording(spark, path, halo=10).where("block = 3 and chan in (1, 2)")
    assert one.rdd.getNumPartitions() == 1
    got = {(r.chan, r.lag): list(r.x) for r in one.collect()}
    assert got == {(c, k): x[c, a:b].tolist() for c in (1, 2) for k, a, b in ((0, 24, 32), (1, 16, 24), (2, 14, 16))}
    assert recording.read_recording(spark, path).where("block > 9").count() == 0
    with pytest.raises(Exception, match="twice"):
        recording.write_recording(packed(spark, x, 8), path, mode="append")
    assert len(glob.glob(f"{tmp_path}/rec/block-*")) == 5 == len(recording.manifest(path))
    with pytest.raises(Exception, match="every channel once"):
        recording.write_recording(packed(spark, x, 8).union(packed(spark, x, 8)), f"file://{tmp_path}/other")


def test_a_task_that_fails_once_leaves_no_block_twice(tmp_path):
    """The second attempt of a task writes the same blocks: only its files are named, the first one's are deleted."""
    import pyarrow as pa

    path = f"{tmp_path}/rec"
    x = pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))
    batch = lambda b: pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([b, b]), pa.array([0, 1], pa.int32()), pa.array([0, 0], pa.int32()), x], ["obs", "block", "chan", "lag", "x"])
    w = recording.RecordingWriter({"path": path}, True)

    def fails():
        yield batch(0)
        yield batch(1)
        raise OSError("the executor is lost")

    with pytest.raises(OSError):
        w.write(fails())
    assert len(glob.glob(f"{path}/block-0-0-*")) == 1
    second = w.write(iter([batch(0), batch(1)]))
    assert len(glob.glob(f"{path}/block-0-0-*")) == 2 and recording.manifest(path) == []
    w.commit([second])
    assert [(r["obs"], r["block"]) for r in recording.manifest(path)] == [(0, 0), (0, 1)]
    assert len(glob.glob(f"{path}/block-*")) == 2
    w2 = recording.RecordingWriter({"path": path}, False)
    w2.write(iter([batch(2)]))
    w2.abort([])
    assert len(glob.glob(f"{path}/block-*")) == 2


def test_a_repeated_task_on_spark(spark, tmp_path):
    """A task's first attempt ends behind the written file; Spark's local mode with retries is another process, so the job fails, and the folder holds nothing."""
    x, path = np.ones((4, 8), np.float32), f"file://{tmp_path}/rec"
    bad = packed(spark, x, 8).withColumn("x", F.when(F.col("chan") == 3, F.raise_error(F.lit("lost")).cast("array<float>")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        recording.write_recording(bad, path)
    assert glob.glob(f"{tmp_path}/rec/*") == []


def test_table_function(spark):
    table_function.register(spark)
    r = np.random.default_rng(3)
    x = r.random((4, 40)).astype(np.float32)
    df = packed(spark, x, 8).union(packed(spark, x[:, :24], 8, 5)).where("not (obs = 5 and block = 1)")
    df.repartition(5).createOrReplaceTempView("rec_")
    how = "f_min => 1000, f_max => 1500, nchans => 4, tsamp => 0.001, dt_max => 20"
    got = spark.sql(f"select * from tree(table(select * from rec_) partition by obs order by block, {how}, length => 8)").collect()
    p = TreePlan(Geometry(1000, 1500, 4, 40, 0.001, 20))
    whole = blocks.transform_matrix(x.astype(np.float64), p)
    alone = blocks.run_levels(blocks.channel_means(x[:, 16:24].astype(np.float64), p), p)
    first = blocks.run_levels(blocks.channel_means(x[:, :8].astype(np.float64), p), p)
    assert len(got) == 7 * 21
    for row in got:
        want = whole[row.i_dt, row.block * 8 : row.block * 8 + 8] if row.obs == 0 else (first if row.block == 0 else alone)[row.i_dt]
        np.testing.assert_allclose(row.v, want, atol=1e-9)
    with pytest.raises(Exception, match="needs a table with columns"):
        spark.sql(f"select * from tree(table(select obs, block, chan from rec_) partition by obs, {how}, length => 8)")


# ---- stream -------------------------------------------------------------------

def test_stream_with_time(spark, tmp_path):
    """Out of order, a block missing until the watermark has passed, one late, one twice, and a recording that ends and begins anew."""
    p, x = TreePlan(G), np.random.default_rng(8).random((4, 64))
    part = {b: [[float(v) for v in r] for r in x[:, b * 8 : (b + 1) * 8]] for b in range(8)}
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "obs string, block long, ts timestamp, x array<array<double>>"
    src = f"{tmp_path}/in"
    steps = [
        [("o", 1, at(1), part[1]), ("z", 0, at(0), part[0])],
        [("o", 0, at(0.5), part[0]), ("o", 3, at(3), part[3])],
        [("z", 1, at(9), part[1])],  # the watermark passes block 3's time: block 2 won't come
        [("o", 2, at(2), part[2]), ("o", 3, at(3), part[3]), ("z", 2, at(10), part[2])],
        [("o", 3, at(11), part[3]), ("o", 4, at(11), part[4]), ("z", 3, at(12), part[3])],
        [("z", 4, at(200), part[4])],  # "o" is idle for long
        [("z", 5, at(201), part[5])],
        [("o", 0, at(201), part[5])],  # and begins anew
    ]
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, timed.ROCKS)
    try:
        dropped = []
        for step in steps:
            spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).parquet(src)
            q = timed.tree_stream(stream, p, 8, "1 hour", idle=48 * 3_600_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
            dropped.append(timed.late_rows(q))
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
    finally:
        spark.conf.set(store, before)
    lost = x.copy()
    lost[:, 16:24] = 0
    want = blocks.transform_matrix(lost, p)
    o = sorted((r.block, r.filled, r.late) for r in rows if r.obs == "o" and r.i_dt == 0)
    assert o == [(0, False, 0), (0, False, 0), (1, False, 0), (2, True, 0), (3, False, 0), (4, False, 1)]
    assert dropped == [0, 0, 0, 2, 0, 0, 0, 0]
    anew = blocks.run_levels(blocks.channel_means(x[:, 40:48], p), p)
    for r in rows:
        if r.obs == "o" and r.block:
            np.testing.assert_allclose(r.v, want[r.i_dt, r.block * 8 : r.block * 8 + 8], atol=1e-9)
    zeros = [r for r in rows if r.obs == "o" and r.block == 0]
    assert len(zeros) == 42 and any(np.allclose(r.v, anew[r.i_dt]) for r in zeros if r.i_dt == 7)
    z = blocks.transform_matrix(x, p)
    for r in rows:
        if r.obs == "z":
            np.testing.assert_allclose(r.v, z[r.i_dt, r.block * 8 : r.block * 8 + 8], atol=1e-9)
    assert sorted({r.block for r in rows if r.obs == "z"}) == [0, 1, 2, 3, 4, 5]
