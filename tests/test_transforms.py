"""Invariants, golden plan shapes, kernel vectors and brute force for the transforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpsieve.api import DirectTransform, TreeTransform
from chirpsieve.functions import dispersion as fn
from chirpsieve.operators import blocks, direct, pulse, tree
from chirpsieve.plans import frames
from chirpsieve.plans.geometry import DirectGeometry, Geometry, dm_range
from chirpsieve.plans.tree import TreePlan
from chirpsieve.sources import waterfall

SHAPES = {
    (1000, 1500, 500, 0.001, 512): "500/2/3/1071, 250/2/5/753, 125/3/8/636, 63/3/16/577, 32/3/30/545, 16/12/57/528, 8/31/109/521, 4/73/198/516, 2/176/338/514, 1/513/513/513",
    (1104, 1440, 336, 0.001, 512): "336/2/3/832, 168/3/5/671, 84/5/10/595, 42/9/19/553, 21/17/36/532, 11/17/70/522, 6/17/133/517, 3/89/246/515, 2/89/425/514, 1/513/513/513",
    (704, 1216, 4096, 8.192e-5, 2048): "4096/1/2/5775, 2048/1/3/4216, 1024/2/5/3050, 512/3/10/2563, 256/4/18/2308, 128/8/36/2175, 64/15/70/2110, 32/29/136/2082, 16/58/263/2063, 8/119/493/2056, 4/258/876/2052, 2/625/1425/2050, 1/2049/2049/2049",
}


@pytest.mark.parametrize("key", SHAPES)
@pytest.mark.parametrize("precision", ["float64", "float32"])
def test_plan_shapes(key, precision):
    f0, f1, n, ts, dt = key
    p = TreePlan(Geometry(f0, f1, n, 4096, ts, dt, precision=precision))
    assert ", ".join("/".join(map(str, x.shape())) for x in p.levels) == SHAPES[key]


def test_class_numbers():
    t = TreeTransform(1000, 1500, 500, 1024, 0.001, 512)
    assert (t.df, t.correction, t.niters, len(t.plan.levels), len(t.dt_grid_final), len(t.dm_grid_final)) == (1.0, 0.5, 9, 10, 513, 513)
    assert abs(t.geometry.dm_step - 0.4338) < 1e-4 and t.plan.memory_usage() > 0
    out = t.execute(np.ones((500, 1024)))
    assert out.shape == (513, 1024) and (out[:, -1] == 500).all() and out.sum(dtype=np.float64) == 223_263_968
    assert t.initialise(np.ones((500, 1024))).shape == (1071, 1024)
    with pytest.raises(ValueError):
        t.execute(np.ones((500, 1023)))


def test_worked_plan():
    p = TreePlan(Geometry(1000, 1500, 6, 32, 0.001, 8)).flatten()
    rows = lambda dt: [tuple(int(p[k][i]) for k in ("chan", "w", "shift")) for i in np.flatnonzero(p["dt"] == dt)]
    assert rows(3) == [(0, 0, 0), (1, 0, 1), (2, 0, 1), (3, 0, 2), (4, 0, 3), (5, 0, 3)]
    assert rows(8) == [(0, 1, 0), (1, 1, 2), (2, 1, 4), (3, 0, 6), (4, 0, 7), (5, 0, 8)]


def brute(x, p):
    """The closed form, sample by sample."""
    f, n = p.flatten(), x.shape[1]
    out = np.zeros((len(p.dt_grid), n))
    for i, c, w, s in zip(f["i_dt"], f["chan"], f["w"], f["shift"]):
        for t in range(s + w, n):
            out[i, t] += x[c, t - s - w : t - s + 1].mean()
    return out


GEOS = [dict(nchans=1, dt_max=3), dict(nchans=2, dt_max=6), dict(nchans=5, dt_max=20), dict(nchans=6, dt_max=8), dict(nchans=8, dt_max=16, dt_step=3, dt_min=2), dict(nchans=13, dt_max=25), dict(nchans=16, dt_max=30, dt_min=7)]


@pytest.mark.parametrize("geo", GEOS)
def test_matrix_is_closed_form_and_keeps_invariants(geo):
    g = Geometry(1000, 1500, nsamps=64, tsamp=0.001, **geo)
    p, r = TreePlan(g), np.random.default_rng(3)
    x, y = r.random((2, g.nchans, 64))
    run = lambda m: blocks.transform_matrix(m, p)
    np.testing.assert_allclose(run(x), brute(x, p), atol=1e-9)
    np.testing.assert_allclose(run(2 * x - y), 2 * run(x) - run(y), atol=1e-9)
    h = p.halo()
    assert h == int((p.flatten()["shift"] + p.flatten()["w"]).max())
    np.testing.assert_allclose(run(np.ones_like(x))[:, h:], g.nchans, atol=1e-9)
    if g.dt_min == 0:
        np.testing.assert_allclose(run(x)[0], x.sum(0), atol=1e-9)
    moved = np.roll(x, 5, axis=1)
    np.testing.assert_allclose(run(moved)[:, h + 5 :], run(x)[:, h:-5], atol=1e-9)
    f = p.flatten()
    for i in range(len(p.dt_grid)):
        assert sorted(f["chan"][f["i_dt"] == i]) == list(range(g.nchans))


def packed(spark, x, length, obs=None):
    rows = [(c, b, [float(v) for v in x[c, b * length : (b + 1) * length]]) for c in range(x.shape[0]) for b in range(-(-x.shape[1] // length))]
    return spark.createDataFrame(rows, "chan int, block long, x array<double>")


@pytest.mark.parametrize("length", [7, 20, 64])
def test_blocks_equal_one_matrix(spark, length):
    g = Geometry(1000, 1500, 6, 64, 0.001, 30)
    p, x = TreePlan(g), np.random.default_rng(1).random((6, 64))
    out = waterfall.unpack(blocks.tree_blocks(packed(spark, x, length), p, length), length, "v").collect()
    got = np.zeros((31, 64))
    assert len(out) == got.size
    for r in out:
        got[r.i_dt, r.t] = r.v
    np.testing.assert_allclose(got, blocks.transform_matrix(x, p), atol=1e-9)


def test_keys_keep_observations_apart(spark):
    g = Geometry(1000, 1500, 4, 16, 0.001, 6)
    p, r = TreePlan(g), np.random.default_rng(2)
    xs = {"a": r.random((4, 16)), "b": r.random((4, 16))}
    wf = spark.createDataFrame([(o, c, t, float(x[c, t])) for o, x in xs.items() for c in range(4) for t in range(16)], "obs string, chan int, t int, x double")
    tree.check_waterfall(wf.where("obs = 'a'"), p)
    with pytest.raises(ValueError):
        tree.check_waterfall(wf.where("obs = 'a' and t > 0"), p)
    for run in (tree.tree_transform, tree.flat_transform):
        for row in run(wf, p, ("obs",)).collect():
            assert abs(row.v - blocks.transform_matrix(xs[row.obs], p)[row.i_dt, row.t]) < 1e-9
    best = {r.obs: (r.i_dt, r.t) for r in pulse.peak(tree.tree_transform(wf, p, ("obs",)), by=("obs",)).collect()}
    for o, x in xs.items():
        m = blocks.transform_matrix(x, p)
        assert best[o] == np.unravel_index(m.argmax(), m.shape)
    long = waterfall.pack(wf, 5, ("obs",))
    assert waterfall.unpack(long, 5).count() == wf.count()


def test_direct(spark):
    g = DirectGeometry.from_range(1000, 1500, 4, 0.001, 20, 5)
    assert g.delays()[2].tolist() == [0, -9, -15, -20]
    x = np.random.default_rng(4).random((4, 100))
    m = direct.direct_matrix(x, g)
    reach = int(np.abs(g.delays()).max())
    assert m.shape == (5, 100 - reach)
    wf = spark.createDataFrame([(c, t, float(x[c, t])) for c in range(4) for t in range(100)], "chan int, t int, x double")
    for r in direct.direct_transform(wf, g, 100).collect():
        want = sum(x[c, r.t + g.delays()[r.i_dm, c]] for c in range(4))
        assert abs(r.v - want) < 1e-9 and abs(m[r.i_dm, r.t - reach] - want) < 1e-9
    for length in (16, 100):
        n = 0
        for r in blocks.direct_blocks(packed(spark, x, length), g, length).collect():
            for k, v in enumerate(r.v):
                assert abs(v - m[r.i_dm, r.block * length + r["first"] + k - reach]) < 1e-6
                n += 1
        assert n == m.size
    assert DirectTransform(1000, 1500, 4, 0.001, dms=[10, 0]).execute(x).shape == (2, 80)
    assert DirectTransform(1000, 1500, 4, 0.001, 10, 5).execute(packed(spark, x, 50), 50).count() == 6
    with pytest.raises(ValueError):
        direct.direct_matrix(x[:, :10], g)


def test_validation():
    for bad in (dict(f_min=1500), dict(nchans=0), dict(tsamp=0), dict(dt_step=0), dict(dt_min=99)):
        with pytest.raises(ValueError):
            Geometry(**(dict(f_min=1000, f_max=1400, nchans=4, nsamps=64, tsamp=0.001, dt_max=8) | bad))
    with pytest.raises(ValueError):
        TreePlan(Geometry(1000, 1500, 4, 8, 0.001, 60))
    with pytest.raises(ValueError):
        dm_range(10, 0)
    with pytest.raises(ValueError):
        DirectGeometry(1000, 1500, 4, 0.001, ())
    assert dm_range(1.0, 0.1) == tuple(i * 0.1 for i in range(11))


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v]) if v else F.expr("cast(array() as array<double>)")


def test_scalar_vectors(spark):
    L = F.lit
    assert one(spark, fn.share(L(1000.0), L(1500.0), L(1000.0), L(1500.0))) == 1
    assert one(spark, fn.share(L(1500.0), L(1000.0), L(1500.0), L(1000.0))) == 1
    assert one(spark, fn.share(L(1000.0), L(1000.0), L(1000.0), L(1500.0))) == 0
    assert one(spark, fn.band_delay(L(1000.0), L(1500.0), L(1000.0), L(1500.0), L(100))) == 100
    assert one(spark, fn.band_delay(L(1000.0), L(1500.0), L(1000.0), L(1500.0), L(0))) == 0
    assert one(spark, fn.delay_grid(L(3), L(2), L(1))) == []
    cases = [((10,), 10, 0), ((10,), 15, 0), ((10, 20), 15, 1), ((10, 20, 20, 30, 40, 50), 20, 1), ((10, 20, 20, 30), 21, 2), ((), 10, None)]
    cases += [((10, 20, 30, 40, 50), v, i) for v, i in ((30, 2), (24, 1), (26, 2), (5, 0), (60, 4))]
    for a, v, want in cases:
        assert one(spark, fn.closest_index(arr(*a), L(float(v)))) == want
        if a:
            assert TreePlan.nearest(None, np.array(a), np.array([v]))[0] == want


def test_array_vectors(spark):
    L = F.lit
    add = lambda a, b, off, n: one(spark, fn.add_offset(arr(*a), arr(*b), L(off), L(n)))
    assert add(range(1, 6), range(6, 11), 2, 8) == [1, 2, 9, 11, 13, 9, 10, 0]
    for off, want in enumerate([[1, 3, 5, 7, 0, 0], [0, 2, 4, 6, 4, 0], [0, 1, 3, 5, 3, 4], [0, 1, 2, 4, 2, 3]]):
        assert add(range(4), range(1, 5), off, 6) == want
    for bad in (((1, 2, 3, 4, 5), (1, 2, 3, 4, 5), 2, 4), ((1, 2, 3), (1, 2), 4, 8), ((), (), 0, 3), ((1, 2), (3, 4), 2, 4)):
        with pytest.raises(Exception):
            add(*bad)
    assert one(spark, fn.copy_into(arr(1, 2, 3, 4, 5), L(10))) == [1, 2, 3, 4, 5] + [0] * 5
    assert one(spark, fn.copy_into(arr(), L(5))) == [0] * 5
    with pytest.raises(Exception):
        one(spark, fn.copy_into(arr(1, 2, 3, 4, 5), L(3)))


def test_delays_round_halves_to_even_and_pulse_is_recovered(spark):
    got = [r.delay for r in fn.dm_delays(spark, 200.0, 1104.0, 1440.0, 0.001, 336).orderBy("chan").collect()]
    f = np.arange(336) + 1104.0
    assert got == np.rint(200 * 4148.808 * (1104.0**-2 - f**-2) / 0.001).astype(int).tolist()
    sec = fn.dm_delays(spark, 200.0, 1104.0, 1440.0, 0.001, 336, in_samples=False).agg(F.min("delay"), F.max("delay")).first()
    assert sec[0] == 0 and 0.2 < sec[1] < 0.3
    g = Geometry(1104, 1440, 64, 512, 0.001, 256)
    p = TreePlan(g)
    wf = pulse.simulate_pulse(spark, 1104, 1440, 64, 512, 0.001, 60.0, amp=20, offset=300, noise_rms=2, seed=9)
    m = np.zeros((64, 512))
    for r in wf.collect():
        m[r.chan, r.t] = r.x
    out = blocks.transform_matrix(m, p)
    i, t = np.unravel_index(out.argmax(), out.shape)
    assert abs(p.dm_grid[i] - 60) < 2 * g.dm_step and abs(t - 300) <= 2
    b = pulse.dm_bounds(frames.trials(spark, p)).first()
    assert b.dm_min == 0 and abs(b.dm_max - p.dm_grid[-1]) < 1e-12


def test_matrix_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).random((4, 32)).astype(np.float32)
    t = TreeTransform(1000, 1500, 4, 32, 0.001, 10, precision="float32")
    df = waterfall.from_matrix(spark, x)
    np.testing.assert_allclose(waterfall.to_matrix(t.execute(df)), t.execute(x), rtol=1e-5)
    waterfall.write(df, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 4
    assert t.plan_frame(spark).where("level = 0 and offset is not null").count() == 0


def test_scan_is_pruned(spark):
    plan = waterfall.embeddings(spark, "/root/testdata/sf0.001", 8)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    p = TreePlan(Geometry(1000, 1500, 8, 64, 0.001, 16))
    q = tree.tree_transform(waterfall.embeddings(spark, "/root/testdata/sf0.001", 8), p, ("obs",))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in q and "SortMergeJoin" not in q
    assert q.count("FileScan") == 1 and q.count("Exchange hashpartitioning") == 1 + 3  # means, and a sum for each merge


def test_stream_equals_batch(spark, tmp_path):
    from chirpsieve.streaming.blocks import tree_stream

    g = Geometry(1000, 1500, 4, 64, 0.001, 20)
    p, x = TreePlan(g), np.random.default_rng(8).random((4, 64)).astype(np.float32)
    parts = {b: [[float(v) for v in r] for r in x[:, b * 16 : (b + 1) * 16]] for b in range(4)}
    schema = "obs string, block long, x array<array<float>>"
    src = tmp_path / "in"
    for order in ((1, 0), (0, 3), (2,)):  # out of order, and block 0 again
        spark.createDataFrame([("o", b, parts[b]) for b in order], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = tree_stream(stream, p).writeStream.format("memory").queryName("blocks_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = np.zeros((21, 64))
    rows = spark.table("blocks_out").collect()
    assert len(rows) == 4 * 21
    for r in rows:
        got[r.i_dt, r.block * 16 : (r.block + 1) * 16] = r.v
    np.testing.assert_allclose(got, blocks.transform_matrix(x, p), atol=1e-4)


def test_reports(spark, tmp_path):
    import json

    from chirpsieve.sources.reports import benchmarks

    rows = [dict(name="cpu/plan_seq/2048", real_time=2.0, cpu_time=1.0, time_unit="s"), dict(name="mean", real_time=1, cpu_time=1, time_unit="ms")]
    (tmp_path / "b.json").write_text(json.dumps({"benchmarks": rows}, indent=1))
    got = benchmarks(spark, str(tmp_path / "b.json")).collect()
    assert [tuple(r) for r in got] == [("cpu", "plan_seq", 2048, 2000.0, 1000.0)]
    rows = [dict(name=f"cpu/BM_tree_{what}_{kind}/{n}", real_time=2.0, cpu_time=float(n), time_unit="ms") for what in ("plan", "execute") for kind in ("seq", "par") for n in (8, 16)] + [dict(name="cpu/BM_tree_plan/x", real_time=1, cpu_time=1, time_unit="ms")]
    (tmp_path / "c.json").write_text(json.dumps({"benchmarks": rows}, indent=1))
    from chirpsieve.sources.reports import series

    assert {tuple(r) for r in series(spark, str(tmp_path / "c.json"), "tree_execute").collect()} == {("tree_execute", n, float(n), kind) for kind in ("seq", "par") for n in (8, 16)}
    assert {(r.benchmark_name, r.n, r.benchmark_type) for r in series(spark, str(tmp_path / "c.json")).where("n is null").collect()} == {("tree_plan", None, None)}
    assert series(spark, str(tmp_path / "c.json")).dtypes[1] == ("n", "bigint")


def test_functions_travel_by_value():
    """Executors without the package on their path can run its functions."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from chirpsieve.operators import blocks as b

    data = cloudpickle.dumps((b.transform_matrix, TreePlan(Geometry(1000, 1500, 4, 16, 0.001, 6))))
    code = "import sys, pickle, numpy as np; f, p = pickle.loads(sys.stdin.buffer.read()); print(f(np.ones((4, 16)), p).shape)"
    out = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, cwd="/", env={"PATH": "/usr/bin"})
    assert out.stdout.decode().strip() == "(7, 16)", out.stderr.decode()[-500:]


def test_whole_lineitem_is_binned(spark):
    from chirpsieve.queries import queries

    sf = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]
    assert queries()["waterfall_lineitem"](spark, sf).agg(F.sum("x")).first()[0] == total
    with pytest.raises(Exception, match="outside the 6 x 96 bins"):
        waterfall.lineitem(spark, sf, 6, 96).collect()


def test_every_vector_is_an_observation(spark):
    from chirpsieve.queries import queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    out = queries()["tree_one_channel"](spark, sf)
    assert out.select("obs").distinct().count() == n > 8


def test_inputs_of_another_shape_raise(spark):
    p = TreePlan(Geometry(1000, 1500, 4, 16, 0.001, 6))
    cells = [(o, c, t, 1.0) for o in (0, 1) for c in range(4) for t in range(16)]
    schema = "obs int, chan int, t int, x double"
    wf = spark.createDataFrame(cells, schema)
    tree.check_waterfall(wf, p, ("obs",))
    for row in ((0, 4, 0, 1.0), (0, 0, 16, 1.0), (0, -1, 0, 1.0), (0, None, 0, 1.0)):
        bad = spark.createDataFrame([*cells, row], schema)
        for run in (tree.tree_transform, tree.flat_transform):
            with pytest.raises(Exception, match="4 x 16 is needed"):
                run(bad, p, ("obs",)).collect()
    for bad in (wf.where("not (obs = 1 and chan = 2)"), wf.where("t < 15"), wf.limit(0), wf.union(wf.limit(1))):
        with pytest.raises(ValueError):
            tree.check_waterfall(bad, p, ("obs",))
    for bad in (wf.where("not (obs = 1 and chan = 2)"), wf.where("t < 15"), wf.where("not (obs = 0 and chan = 1 and t = 7)"), wf.union(wf.where("obs = 0 and chan = 0 and t = 9")), wf.union(wf)):
        for run in (tree.tree_transform, tree.flat_transform):
            with pytest.raises(Exception, match="4 x 16 is needed"):
                run(bad, p, ("obs",)).collect()
        with pytest.raises(Exception, match="4 x 16 is needed"):
            direct.direct_transform(bad, DirectGeometry(1000, 1500, 4, 0.001, (0.0, 2.0)), 16, ("obs",)).collect()
    assert tree.tree_transform(wf.limit(0), p, ("obs",)).count() == 0
    lacking = wf.where("not (obs = 1 and chan in (0, 2))")
    got = {(r.obs, r.i_dt, r.t): r.v for r in tree.tree_transform(lacking, p, ("obs",), absent="zero").collect()}
    m = np.ones((4, 16))
    m[[0, 2]] = 0
    for o, x in ((0, np.ones((4, 16))), (1, m)):
        for (i, t), v in np.ndenumerate(blocks.transform_matrix(x, p)):
            assert abs(got[o, i, t] - v) < 1e-9
    packed = spark.createDataFrame([(4, 0, [1.0] * 16)], "chan int, block long, x array<float>")
    with pytest.raises(Exception, match="channels 0 to 3"):
        blocks.tree_blocks(packed, p, 16).collect()


@pytest.mark.parametrize("block", [1, 7, 24, 1024])
def test_means_are_those_of_a_loop(spark, block):
    p = TreePlan(Geometry(1000, 1500, 4, 24, 0.001, 20))
    x = {(c, t): float(c * 100 + t * t) for c in range(4) for t in range(24)}
    wf = spark.createDataFrame([(c, t, v) for (c, t), v in x.items()], "chan int, t int, x double")
    base = p.levels[0]
    for dense in (False, True):
        got = {(r.chan, r.i_dt, r.t): r.v for r in tree.means(wf, p, (), dense, block).collect()}
        want = {}
        for c, i, w in zip(base.band.tolist(), base.index.tolist(), base.delay.tolist()):
            for t in range(0 if dense else w, 24):
                want[c, i, t] = sum(x[c, u] for u in range(t - w, t + 1)) / (w + 1) if t >= w else 0.0
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_work_on_means_does_not_grow_with_the_square_of_the_delay(spark):
    """A sample is shuffled once, plus once for the block behind it; not once for each cell that looks back on it."""
    wf = spark.range(256).selectExpr("0 as chan", "cast(id as int) as t", "double(id) as x")
    p = TreePlan(Geometry(1000, 1500, 1, 256, 0.001, 63))
    plan = tree.means(wf, p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate explode(sequence" not in plan.split("Exchange hashpartitioning")[1]


def test_direct_class_takes_masks_and_frames_without_length(spark):
    from chirpsieve import DirectTransform

    x = np.random.default_rng(1).random((4, 64)).astype(np.float32)
    t = DirectTransform(1000, 1500, 4, 0.001, dms=(0.0, 5.0, 10.0))
    zeroed = x.copy()
    zeroed[2] = 0
    np.testing.assert_allclose(t.execute(x, masked=(2,)), t.execute(zeroed))
    got = np.stack([r.v for r in t.execute(waterfall.from_matrix(spark, x), masked=(2,)).orderBy("i_dm").collect()])
    np.testing.assert_allclose(got, t.execute(zeroed), rtol=1e-6)


def test_pulse_array_is_the_frame(spark):
    import chirpsieve
    from chirpsieve.operators.pulse import simulate_pulse

    how = dict(f_min=1104.0, f_max=1440.0, nchans=16, nsamps=64, tsamp=0.001, dm=40.0, amp=3.0, offset=50, width=2)
    x = chirpsieve.generate_pulse(**how)
    assert x.shape == (16, 64)
    assert all(x[r.chan, r.t] == r.x for r in simulate_pulse(spark, **how).collect())
