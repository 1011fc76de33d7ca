"""The transform of rows with one shuffle: against matrices, against the row form, on inputs of another shape, and its plan."""

import numpy as np
import pytest

import __spark_entry__ as entry
from chirpsieve.operators import blocks, packed, tree
from chirpsieve.plans.geometry import Geometry
from chirpsieve.plans.tree import TreePlan

GEOMETRIES = [
    Geometry(1000, 1500, 7, 64, 0.001, 40),
    Geometry(1000, 1500, 4, 64, 0.001, 60),
    Geometry(1000, 1500, 8, 200, 0.001, 16, dt_step=3, dt_min=2),
    Geometry(1000, 1500, 1, 30, 0.001, 5),
    Geometry(1000, 1500, 2, 12, 0.001, 9),
]


@pytest.mark.parametrize("geometry", range(len(GEOMETRIES)))
@pytest.mark.parametrize("block", [1, 24, 1024])
def test_packed_is_the_matrix(spark, geometry, block):
    g = GEOMETRIES[geometry]
    p, r = TreePlan(g), np.random.default_rng(geometry)
    x = {o: r.integers(-50, 50, (g.nchans, g.nsamps)).astype(float) for o in (0, None)}
    wf = spark.createDataFrame([(o, c, t, float(v)) for o, m in x.items() for (c, t), v in np.ndenumerate(m)], "obs long, chan int, t int, x double").repartition(5)
    low = p.lowest()
    for run in (packed.tree_packed, packed.flat_packed):
        for dense in (True, False):
            rows = run(wf, p, ("obs",), dense, block=block).collect()
            got = {(q.obs, q.i_dt, q.t): q.v for q in rows}
            want = {(o, i, t): v for o, m in x.items() for (i, t), v in np.ndenumerate(blocks.transform_matrix(m, p)) if dense or t >= low[i]}
            assert len(rows) == len(want) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    mine, other = (run(wf, p, ("obs",)) for run in (packed.tree_packed, tree.tree_transform))
    assert mine.schema.simpleString() == other.schema.simpleString()
    assert {tuple(q)[:4] for q in mine.drop("v").collect()} == {tuple(q)[:4] for q in other.drop("v").collect()}


def test_packed_inputs_of_another_shape(spark):
    p = TreePlan(Geometry(1000, 1500, 4, 16, 0.001, 6))
    schema = "obs int, chan int, t int, x double"
    cells = [(o, c, t, float(c + t * t)) for o in (0, 1) for c in range(4) for t in range(16)]
    wf = spark.createDataFrame(cells, schema)
    outside = [spark.createDataFrame([*cells, row], schema) for row in ((0, 4, 0, 1.0), (0, 0, 16, 1.0), (0, -1, 0, 1.0), (0, None, 0, 1.0), (0, 0, None, 1.0))]
    lacking = [wf.where("not (obs = 1 and chan = 2)"), wf.where("t < 15"), wf.where("not (obs = 0 and chan = 1 and t = 7)"), wf.union(wf.where("obs = 0 and chan = 0 and t = 9")), wf.union(wf)]
    for run in (packed.tree_packed, packed.flat_packed):
        for bad in outside + lacking:
            for block in (2, 1024):
                with pytest.raises(Exception, match="4 x 16 is needed"):
                    run(bad, p, ("obs",), block=block).collect()
        with pytest.raises(ValueError, match="absent"):
            run(wf, p, ("obs",), absent="skip")
        assert run(wf.limit(0), p, ("obs",)).count() == 0 and run(wf.limit(0).drop("obs"), p).count() == 0
        assert run(wf.where("obs = 0").drop("obs"), p).count() == len(p.dt_grid) * 16
        got = {(r.obs, r.i_dt, r.t): r.v for r in run(wf.where("not (obs = 1 and chan in (0, 2))"), p, ("obs",), absent="zero").collect()}
        for o in (0, 1):
            m = np.array([[0.0 if o and c in (0, 2) else c + t * t for t in range(16)] for c in range(4)], dtype=float)
            for (i, t), v in np.ndenumerate(blocks.transform_matrix(m, p)):
                assert abs(got[o, i, t] - v) < 1e-9


@pytest.mark.parametrize("name", ["tree_wide_embeddings", "tree_embeddings", "tree_flat_embeddings", "tree_stepped_embeddings", "tree_one_channel", "tree_two_channels"])
def test_only_samples_are_shuffled(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Exchange Single" not in plan
    # the samples, before anything is made of them
    assert "Generate posexplode(embedding" in plan.split("Exchange hashpartitioning")[1] and "transform" not in plan.split("Exchange hashpartitioning")[1]
