"""Registered queries of the transforms, each with the SQL that checks it.

Sums of doubles are rounded to six places on both sides, since engines add in
different orders.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dispersion as fn
from .operators import blocks, direct, joins, packed, pulse, table_function, tree
from .plans import frames
from .plans.geometry import DISPERSION, SIMULATOR_DISPERSION, DirectGeometry, Geometry
from .plans.tree import TreePlan
from .sources import recording, waterfall
from .streaming import timed

BAND = dict(f_min=1000.0, f_max=1500.0, tsamp=0.001)
GEOMETRIES = {
    "small": Geometry(nchans=8, nsamps=64, dt_max=16, **BAND),
    "wide": Geometry(nchans=4, nsamps=64, dt_max=60, **BAND),
    "odd": Geometry(nchans=7, nsamps=64, dt_max=40, **BAND),
    "stepped": Geometry(nchans=8, nsamps=64, dt_max=16, dt_step=3, dt_min=2, **BAND),
    "months": Geometry(nchans=6, nsamps=120, dt_max=30, **BAND),  # 1992 to 2001
    "one": Geometry(nchans=1, nsamps=64, dt_max=5, **BAND),
    "two": Geometry(nchans=2, nsamps=64, dt_max=9, **BAND),
}
DIRECT = DirectGeometry(1000.0, 1500.0, 4, 0.001, (0.0, 5.0, 10.0, 20.0))
PULSE = dict(f_min=1104.0, f_max=1440.0, nchans=32, nsamps=256, tsamp=0.001, dm=60.0, amp=20.0, offset=180, width=2)


GEOMETRIES["pulse"] = Geometry(PULSE["f_min"], PULSE["f_max"], PULSE["nchans"], PULSE["nsamps"], PULSE["tsamp"], 128)


@functools.cache
def plan(name: str) -> TreePlan:
    return TreePlan(GEOMETRIES[name])


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _shown(df: DataFrame) -> DataFrame:
    return _rounded(df, "dm", "v")


# ---- SQL pieces -----------------------------------------------------------

def _values(rows, names: str) -> str:
    return "(select * from (values " + ", ".join("(" + ", ".join(map(repr, r)) + ")" for r in rows) + f") as v({names}))"


def _flat_sql(name: str) -> str:
    p = plan(name).flatten()
    return _values(zip(*(p[k].tolist() for k in ("i_dt", "dt", "chan", "w", "shift"))), "i_dt, dt, chan, w, shift")


def _dense_sql(n: int, samples: int, inner: str) -> str:
    return f"(select g.chan, g.t, coalesce(sum(b.x), 0.0) as x from (select cast(c.range as integer) as chan, cast(s.range as integer) as t from range({n}) c, range({samples}) s) g left join ({inner}) b on b.chan = g.chan and b.t = g.t group by 1, 2)"


def wf_events_sql(n: int, samples: int = 64) -> str:
    return _dense_sql(n, samples, f"select cast(user_id % {n} as integer) as chan, cast(floor(epoch(ts - timestamp '2024-01-01 00:00:00') / 43200) as integer) as t, round(value * 100) as x from events")


def wf_lineitem_sql(n: int, samples: int = 120) -> str:
    return _dense_sql(n, samples, f"select cast(l_suppkey % {n} as integer) as chan, cast((year(cast(l_shipdate as date)) - 1992) * 12 + month(cast(l_shipdate as date)) - 1 as integer) as t, l_quantity as x from lineitem")


def tree_sql(name: str, wf: str) -> str:
    """The closed form: for each trial, the sum over channels of the mean of the w + 1 samples that end at t - shift."""
    g = GEOMETRIES[name]
    return f"""
    with wf as {wf}, flat as {_flat_sql(name)},
    means as (select f.i_dt, f.chan, cast(a.t + f.shift as integer) as t, avg(b.x) as m from flat f join wf a on a.chan = f.chan and a.t >= f.w join wf b on b.chan = a.chan and b.t between a.t - f.w and a.t
              where a.t + f.shift < {g.nsamps} group by f.i_dt, f.chan, a.t, f.shift),
    grid as (select i.i_dt, i.dt, cast(s.range as integer) as t from (select distinct i_dt, dt from flat) i, range({g.nsamps}) s)
    select cast(grid.i_dt as integer) as i_dt, cast(grid.dt as integer) as dt, round(cast(grid.dt as double) * {g.dm_step!r}, 6) as dm, grid.t, round(coalesce(sum(m), 0.0), 6) as v from grid left join means on means.i_dt = grid.i_dt and means.t = grid.t group by all"""


def whole_sql(p: TreePlan, wf: str) -> str:
    """The closed form for each observation of wf (obs, chan, t, x)."""
    g, f = p.geometry, p.flatten()
    flat = _values(zip(*(f[k].tolist() for k in ("i_dt", "dt", "chan", "w", "shift"))), "i_dt, dt, chan, w, shift")
    return f"""
    with wf as {wf}, flat as {flat},
    means as (select a.obs, f.i_dt, cast(a.t + f.shift as integer) as t, avg(b.x) as m from flat f join wf a on a.chan = f.chan and a.t >= f.w join wf b on b.obs = a.obs and b.chan = a.chan and b.t between a.t - f.w and a.t
              where a.t + f.shift < {g.nsamps} group by a.obs, f.i_dt, f.chan, a.t, f.shift),
    grid as (select o.obs, i.i_dt, i.dt, cast(s.range as integer) as t from (select distinct obs from wf) o, (select distinct i_dt, dt from flat) i, range({g.nsamps}) s)
    select grid.obs, cast(grid.i_dt as integer) as i_dt, cast(grid.dt as integer) as dt, round(cast(grid.dt as double) * {g.dm_step!r}, 6) as dm, grid.t, round(coalesce(sum(m), 0.0), 6) as v from grid left join means on means.obs = grid.obs and means.i_dt = grid.i_dt and means.t = grid.t group by all"""


def direct_sql(wf: str, nsamps: int, masked: tuple = ()) -> str:
    k, f = DISPERSION / DIRECT.tsamp, f"({DIRECT.f_min} + chan * {(DIRECT.f_max - DIRECT.f_min) / DIRECT.nchans})"
    dms = ", ".join(f"({i}, {dm!r})" for i, dm in enumerate(DIRECT.dms))
    reach = f"(select max(abs(delay)) from d)"
    drop = f"where wf.chan not in ({', '.join(map(str, masked))})" if masked else ""
    return f"""with wf as {wf}, d as (select i_dm, dm, cast(range as integer) as chan, cast(round({k!r} * (1 / ({f} * {f}) - 1 / ({DIRECT.f_min} * {DIRECT.f_min})) * dm) as integer) as delay
      from (values {dms}) as v(i_dm, dm), (select range, range as chan from range({DIRECT.nchans})))
    select cast(i_dm as integer) as i_dm, cast(dm as double) as dm, cast(wf.t - delay as integer) as t, round(sum(x), 6) as v from wf join d on d.chan = wf.chan and wf.t - delay >= {reach} and wf.t - delay < {nsamps} {drop} group by all"""


def _blocks(spark, sf, name="small", length=24):
    p, by = plan(name), ("obs",)
    packed = waterfall.pack(waterfall.embeddings(spark, sf, p.geometry.nchans), length, by)
    out = waterfall.unpack(blocks.tree_blocks(packed, p, length, by, absent="zero"), length, "v")
    return out.select("obs", "i_dt", "dt", F.round("dm", 6).alias("dm"), F.col("t").cast("int").alias("t"), F.round("v", 6).alias("v"))


def _level_blocks(spark, sf, i, name="small", length=24):
    p, by = plan(name), ("obs",)
    packed = waterfall.pack(waterfall.embeddings(spark, sf, p.geometry.nchans), length, by)
    out = waterfall.unpack(blocks.level_blocks(packed, p, i, length, by, absent="zero"), length, "v")
    return out.select("obs", "i_sub", "i_dt", F.col("t").cast("int").alias("t"), F.round("v", 6).alias("v"))


def _level_blocks_sql(i, name="small") -> str:
    g, flat = GEOMETRIES[name], _level_flat(name, i)
    wf = f"(select vec_id // {g.nchans} as obs, cast(vec_id % {g.nchans} as integer) as chan, cast(generate_subscripts(embedding, 1) - 1 as integer) as t, cast(unnest(embedding) as double) as x from embeddings)"
    return f"""with wf as {wf}, flat as {flat},
    m as (select a.obs, f.i_sub, f.i_dt, f.chan, cast(a.t + f.shift as integer) as t, avg(b.x) as m from flat f join wf a on a.chan = f.chan and a.t >= f.w join wf b on b.obs = a.obs and b.chan = a.chan and b.t between a.t - f.w and a.t
          where a.t + f.shift < {g.nsamps} group by a.obs, f.i_sub, f.i_dt, f.chan, a.t, f.shift),
    grid as (select o.obs, i.i_sub, i.i_dt, cast(s.range as integer) as t from (select distinct obs from wf) o, (select distinct i_sub, i_dt from flat) i, range({g.nsamps}) s)
    select grid.obs, cast(grid.i_sub as integer) as i_sub, cast(grid.i_dt as integer) as i_dt, grid.t, round(coalesce(sum(m), 0.0), 6) as v from grid left join m on m.obs = grid.obs and m.i_sub = grid.i_sub and m.i_dt = grid.i_dt and m.t = grid.t group by all"""


def _level_states(spark, sf, i):
    p = plan("odd")
    s = tree.initial_state(waterfall.events(spark, sf, 7), p)
    for k in range(1, i + 1):
        s = tree.merge_level(s, p, k)
    return _rounded(s, "v")


def _shapes(spark, sf):
    out = None
    for name in sorted(GEOMETRIES):
        m = frames.mappings(spark, plan(name))
        n = m.groupBy("level", "i_sub").agg(F.count(F.lit(1)).alias("n"))
        s = n.groupBy("level").agg(F.count(F.lit(1)).cast("int").alias("bands"), F.min("n").cast("int").alias("least"), F.max("n").cast("int").alias("most"), F.sum("n").cast("int").alias("rows")).withColumn("geometry", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def _shapes_sql() -> str:
    rows = [(name, i, *x.shape()) for name in sorted(GEOMETRIES) for i, x in enumerate(plan(name).levels)]
    return f"select geometry, cast(level as integer) as level, cast(bands as integer) as bands, cast(least as integer) as least, cast(most as integer) as most, cast(rows as integer) as rows from {_values(rows, 'geometry, level, bands, least, most, rows')}"


def _channel_grids(spark, sf):
    """Level 0 of the plan from Columns alone."""
    g = GEOMETRIES["odd"]
    c = spark.range(g.nchans).select(F.col("id").cast("int").alias("chan"))
    start, end = F.col("chan") * g.df + g.f_min, F.col("chan") * g.df + g.f_min + g.df
    lo, hi = (fn.band_delay(start, end, g.f_min, g.f_max, dt) for dt in (g.dt_min, g.dt_max))
    return c.select("chan", F.round(fn.share(start, end, g.f_min, g.f_max), 9).alias("share"), F.posexplode(fn.delay_grid(lo, hi, F.lit(g.dt_step))).alias("i_dt", "dt"))


def _channel_grids_sql() -> str:
    g = GEOMETRIES["odd"]
    return f"""with b as (select cast(range as integer) as chan, range * {g.df!r} + {g.f_min} as a, range * {g.df!r} + {g.f_min} + {g.df!r} as z from range({g.nchans})),
    s as (select chan, (pow(a, -2) - pow(z, -2)) / (pow({g.f_min}, -2) - pow({g.f_max}, -2)) as share from b)
    select chan, round(share, 9) as share, cast(d - lo as integer) as i_dt, cast(d as integer) as dt from (select chan, share, cast(round({g.dt_min} * share) as integer) as lo, unnest(range(cast(round({g.dt_min} * share) as integer), cast(round({g.dt_max} * share) as integer) + 1)) as d from s)"""


def _closest(spark, sf):
    """For each order's key, the nearest of its lines' quantities (sorted, distinct) to 20."""
    q = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_quantity")).alias("a"))
    return q.select("l_orderkey", fn.closest_index(F.col("a"), F.lit(20.0)).cast("int").alias("idx"))


CLOSEST_SQL = """with q as (select distinct l_orderkey, l_quantity from lineitem), r as (select l_orderkey, l_quantity, row_number() over (partition by l_orderkey order by l_quantity) - 1 as i from q),
n as (select *, row_number() over (partition by l_orderkey order by abs(l_quantity - 20.0), i desc) as k from r) select l_orderkey, cast(i as integer) as idx from n where k = 1"""


def _add_offset(spark, sf):
    """Neighbouring vectors (2 i, 2 i + 1) merged at an offset of their number, on 70 cells."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.floor(F.col("vec_id") / 2)).alias("pair"), (F.col("vec_id") % 2).alias("side"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    p = e.groupBy("pair").agg(F.first(F.when(F.col("side") == 0, F.col("x")), True).alias("a"), F.first(F.when(F.col("side") == 1, F.col("x")), True).alias("b")).where("a is not null and b is not null")
    off = (F.col("pair") % 8).cast("int")
    return p.select("pair", F.posexplode(fn.add_offset("a", "b", off, F.lit(70))).alias("t", "v")).withColumn("v", F.round("v", 6))


ADD_OFFSET_SQL = """with e as (select vec_id // 2 as pair, vec_id % 2 as side, cast(generate_subscripts(embedding, 1) - 1 as integer) as t, cast(unnest(embedding) as double) as x from embeddings),
ok as (select vec_id // 2 as pair from embeddings group by 1 having count(*) = 2),
c as (select pair, t, x from e where side = 0 union all select pair, t + pair % 8, x from e where side = 1)
select g.pair, g.t, round(coalesce(sum(c.x), 0.0), 6) as v from (select pair, cast(range as integer) as t from ok, range(70)) g left join c on c.pair = g.pair and c.t = g.t group by all"""


def _copy(spark, sf):
    e = waterfall_rows(spark, sf)
    return e.select("vec_id", F.posexplode(fn.copy_into(F.transform("embedding", lambda x: x.cast("double")), F.lit(66))).alias("t", "v")).withColumn("v", F.round("v", 6))


def waterfall_rows(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


COPY_SQL = """select vec_id, cast(range as integer) as t, round(coalesce(cast(embedding[range + 1] as double), 0.0), 6) as v from embeddings, range(66)"""


def _dm_grid(spark, sf):
    g = GEOMETRIES["odd"]
    return spark.range(g.dt_min, g.dt_max + 1, g.dt_step).select(F.col("id").cast("int").alias("dt"), F.round(fn.dm_of_delay(F.col("id"), g.f_min, g.f_max, g.tsamp), 9).alias("dm"))


def _dm_grid_sql():
    g = GEOMETRIES["odd"]
    return f"select cast(range as integer) as dt, round(range * ({g.tsamp!r} / ({DISPERSION!r} * (pow({g.f_min}, -2) - pow({g.f_max}, -2)))), 9) as dm from range({g.dt_min}, {g.dt_max} + 1, {g.dt_step})"


def _delay_table_sql():
    k = DISPERSION / DIRECT.tsamp
    step = (DIRECT.f_max - DIRECT.f_min) / DIRECT.nchans
    dms = ", ".join(f"({i}, {dm!r})" for i, dm in enumerate(DIRECT.dms))
    return f"""select cast(i_dm as integer) as i_dm, cast(dm as double) as dm, cast(range as integer) as chan, cast(round({k!r} * (pow({DIRECT.f_min} + range * {step!r}, -2) - pow({DIRECT.f_min}, -2)) * dm) as integer) as delay from (values {dms}) as v(i_dm, dm), range({DIRECT.nchans})"""


_P = PULSE
_PULSE_DELAY = f"round_even({_P['dm']} * {SIMULATOR_DISPERSION!r} * (pow({_P['f_min']}, -2) - pow({_P['f_min']} + c.range * {(_P['f_max'] - _P['f_min']) / _P['nchans']!r}, -2)) / {_P['tsamp']!r}, 0)"
PULSE_SQL = f"""select cast(c.range as integer) as chan, cast(s.range as integer) as t, case when (s.range + cast({_PULSE_DELAY} as bigint)) % {_P['nsamps']} between {_P['offset']} and {_P['offset'] + _P['width'] - 1} then {_P['amp']} else 0.0 end as x
from range({_P['nchans']}) c, range({_P['nsamps']}) s"""
DELAYS_SQL = f"select cast(c.range as integer) as chan, cast({_PULSE_DELAY} as integer) as delay from range({_P['nchans']}) c"


def _numbers(spark, sf):
    g = spark.createDataFrame([(n, x.f_min, x.f_max, x.nchans) for n, x in sorted(GEOMETRIES.items())], "geometry string, f_min double, f_max double, nchans int")
    df = (F.col("f_max") - F.col("f_min")) / F.col("nchans")
    return g.select("geometry", F.round(df, 9).alias("df"), F.round(df / 2, 9).alias("correction"), fn.niters("nchans").alias("niters"))


def _numbers_sql() -> str:
    rows = [(n, x.f_min, x.f_max, x.nchans) for n, x in sorted(GEOMETRIES.items())]
    return f"select geometry, round(cast(f_max - f_min as double) / nchans, 9) as df, round(cast(f_max - f_min as double) / nchans / 2, 9) as correction, cast(ceil(log2(nchans)) as integer) as niters from {_values(rows, 'geometry, f_min, f_max, nchans')}"


def _recovered(spark, sf):
    """A noiseless pulse is found again: the peak's trial and sample."""
    out = tree.tree_transform(pulse.simulate_pulse(spark, **_P), plan("pulse"))
    return _rounded(pulse.peak(out), "dm", "v")


# The embeddings' queries over every vector: query, form, geometry. The last observation may lack channels.
WHOLE = [
    ("tree_flat_embeddings", packed.flat_packed, "small"), ("tree_embeddings", packed.tree_packed, "small"), ("tree_wide_embeddings", packed.tree_packed, "wide"),
    ("tree_stepped_embeddings", packed.tree_packed, "stepped"), ("tree_one_channel", packed.tree_packed, "one"), ("tree_two_channels", packed.tree_packed, "two"),
]


def whole_queries() -> dict:
    emb, by = waterfall.embeddings, ("obs",)
    out = {q: lambda s, d, f=f, name=name: _shown(f(emb(s, d, GEOMETRIES[name].nchans), plan(name), by, absent="zero")) for q, f, name in WHOLE}
    return out | {
        "tree_blocks_embeddings": _blocks,
        "tree_init_embeddings": lambda s, d: _rounded(tree.initial_state(emb(s, d, 8), plan("small"), by), "v"),
        "direct_embeddings": lambda s, d: _rounded(direct.direct_transform(emb(s, d, 4), DIRECT, 64, by, absent="zero"), "v"),
    }


def whole_oracle_sql() -> dict[str, str]:
    wf = lambda n: f"(select vec_id // {n} as obs, cast(vec_id % {n} as integer) as chan, cast(generate_subscripts(embedding, 1) - 1 as integer) as t, cast(unnest(embedding) as double) as x from embeddings)"
    out = {q: whole_sql(plan(name), wf(GEOMETRIES[name].nchans)) for q, _, name in WHOLE}
    p, g = plan("small").levels[0], GEOMETRIES["small"]
    k, f = DISPERSION / DIRECT.tsamp, f"({DIRECT.f_min} + chan * {(DIRECT.f_max - DIRECT.f_min) / DIRECT.nchans})"
    dms = ", ".join(f"({i}, {dm!r})" for i, dm in enumerate(DIRECT.dms))
    return out | {
        "tree_blocks_embeddings": whole_sql(plan("small"), wf(8)),
        "tree_init_embeddings": f"""with wf as {wf(8)}, p as {_values(zip(p.band.tolist(), p.index.tolist(), p.delay.tolist()), "chan, i_dt, w")} select a.obs, cast(p.chan as integer) as i_sub, cast(p.i_dt as integer) as i_dt, a.t, round(avg(b.x), 6) as v
    from p join wf a on a.chan = p.chan and a.t >= p.w and a.t < {g.nsamps} join wf b on b.obs = a.obs and b.chan = a.chan and b.t between a.t - p.w and a.t group by all""",
        "direct_embeddings": f"""with wf as {wf(4)}, d as (select i_dm, dm, cast(range as integer) as chan, cast(round({k!r} * (1 / ({f} * {f}) - 1 / ({DIRECT.f_min} * {DIRECT.f_min})) * dm) as integer) as delay
      from (values {dms}) as v(i_dm, dm), (select range, range as chan from range({DIRECT.nchans})))
    select wf.obs, cast(i_dm as integer) as i_dm, cast(dm as double) as dm, cast(wf.t - delay as integer) as t, round(sum(x), 6) as v from wf join d on d.chan = wf.chan and wf.t - delay >= (select max(abs(delay)) from d) and wf.t - delay < 64 group by all""",
    }


CYCLE = 30 * 86400  # the days that `events` covers: other tables' times are taken modulo these


def _events_at(spark, sf):
    """event_id, user_id, cents, sec: seconds from 2024-01-01."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"), F.timestamp_diff("SECOND", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("ts")).alias("sec"))


EVENTS_AT = "(select event_id, user_id, cast(round(value * 100) as bigint) as cents, cast(floor(epoch(ts - timestamp '2024-01-01 00:00:00')) as bigint) as sec from events)"


def _nearest(side):
    def run(spark, sf):
        """Each order, moved into the events' days, with the nearest event."""
        o = spark.read.parquet(f"{sf}/orders.parquet")
        day = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1990-01-01 00:00:00'"), F.col("o_orderdate").cast("timestamp_ntz"))
        o = o.select("o_orderkey", F.pmod(day + F.pmod(F.col("o_orderkey") * 7919, F.lit(86400)), F.lit(CYCLE)).alias("sec"))
        return joins.nearest_join(o, _events_at(spark, sf), "sec", "event_id", side=side)

    return run


def _nearest_sql(side):
    o = f"(select o_orderkey, ((cast(floor(epoch(cast(o_orderdate as timestamp) - timestamp '1990-01-01 00:00:00')) as bigint) + (o_orderkey * 7919) % 86400) % {CYCLE}) as sec from orders)"
    a, b = (f"(select o.o_orderkey, e.event_id, e.sec from o asof join e on o.sec {sign} e.sec)" for sign in (">=", "<="))
    pick = {"before": ("a.event_id", "a.sec"), "after": ("b.event_id", "b.sec"), "nearest": tuple(f"case when a.sec is null or b.sec - o.sec <= o.sec - a.sec then b.{c} else a.{c} end" for c in ("event_id", "sec"))}[side]
    return f"""with o as {o}, e as (select sec, min(event_id) as event_id from {EVENTS_AT} group by sec)
    select o.o_orderkey, o.sec, {pick[0]} as nearest_event_id, {pick[1]} as nearest_sec from o left join {a} a on a.o_orderkey = o.o_orderkey left join {b} b on b.o_orderkey = o.o_orderkey"""


def _windows(spark, sf):
    """For each line, the events of its customers' group in the l_quantity hours from its shipping (moved into the events' days): how many, and their cents."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    ship = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1990-01-01 00:00:00'"), F.col("l_shipdate").cast("timestamp_ntz"))
    li = li.select("l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(500)).alias("grp"), F.pmod(ship, F.lit(CYCLE)).alias("lo"), F.col("l_quantity").cast("long").alias("hours")).withColumn("hi", F.col("lo") + F.col("hours") * 3600)
    ev = _events_at(spark, sf).withColumn("grp", F.pmod("user_id", F.lit(500)))
    met = joins.interval_totals(ev, li, "sec", "lo", "hi", "cents", ("grp",))
    return met.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


WINDOWS_SQL = f"""with li as (select l_orderkey, l_linenumber, l_partkey % 500 as grp, cast(floor(epoch(cast(l_shipdate as timestamp) - timestamp '1990-01-01 00:00:00')) as bigint) % {CYCLE} as lo, cast(l_quantity as bigint) as hours from lineitem)
select l_orderkey, l_linenumber, count(*) as n, cast(sum(cents) as bigint) as cents from li join (select *, user_id % 500 as grp from {EVENTS_AT}) e on e.grp = li.grp and e.sec between li.lo and li.lo + li.hours * 3600 group by 1, 2"""


def _best_cells(spark, sf):
    """The five strongest cells of every observation."""
    p = plan("small")
    out = packed.tree_packed(waterfall.embeddings(spark, sf, 8), p, ("obs",), absent="zero")
    return pulse.peak(out.withColumn("v", F.round("v", 6)), k=5, by=("obs",))


def _recorded(spark, sf, name="small", length=24):
    """The embeddings written as a recording in the shared folder, and transformed from there block by block."""
    p, by = plan(name), ("obs",)
    path = recording.shared_folder(spark)
    wf = waterfall.embeddings(spark, sf, p.geometry.nchans)
    recording.write_recording(waterfall.pack(wf, length, by), path, slice=16)
    out = waterfall.unpack(blocks.tree_recording(spark, path, p, length, absent="zero"), length, "v")
    return out.select("obs", "i_dt", "dt", F.round("dm", 6).alias("dm"), F.col("t").cast("int").alias("t"), F.round("v", 6).alias("v"))


def _by_sql(spark, sf):
    """tree() of SQL, each observation a partition."""
    table_function.register(spark)
    g, length = GEOMETRIES["small"], 24
    waterfall.pack(waterfall.embeddings(spark, sf, g.nchans), length, ("obs",)).createOrReplaceTempView("recording_")
    out = spark.sql(f"select * from tree(table(select obs, block, chan, x from recording_) partition by obs order by block, f_min => {g.f_min}, f_max => {g.f_max}, nchans => {g.nchans}, tsamp => {g.tsamp}, dt_max => {g.dt_max}, length => {length})")
    return waterfall.unpack(out, length, "v").select("obs", "i_dt", "dt", F.round("dm", 6).alias("dm"), F.col("t").cast("int").alias("t"), F.round("v", 6).alias("v"))


def _streamed(spark, sf, length=8):
    """The events' waterfall, replayed block by block as a stream that ends when all has been read."""
    p, folder = plan("odd"), recording.shared_folder(spark)
    packed = waterfall.pack(waterfall.events(spark, sf, 7), length, ()).withColumn("x", F.col("x").cast("array<double>"))
    block = packed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("chan", "x")))["x"].alias("x"))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("block") * length * 43200)
    rows = block.select(F.lit("events").alias("obs"), F.col("block").cast("long").alias("block"), ts.alias("ts"), "x")
    rows.repartition(4, "block").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(store, timed.ROCKS)
    try:
        out = timed.tree_stream(stream, p, length, delay="40 days")
        run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(store, before)
    got = waterfall.unpack(spark.read.schema(out.schema).parquet(f"{folder}/out").drop("obs", "filled", "late"), length, "v")
    return got.select("i_dt", "dt", F.round(F.col("dt") * p.geometry.dm_step, 6).alias("dm"), F.col("t").cast("int").alias("t"), F.round("v", 6).alias("v"))


def queries() -> dict:
    ev, li = waterfall.events, waterfall.lineitem
    out = {
        "tree_events": lambda s, d: _shown(tree.tree_transform(ev(s, d, 7), plan("odd"))),
        "tree_flat_events": lambda s, d: _shown(tree.flat_transform(ev(s, d, 7), plan("odd"))),
        "tree_lineitem": lambda s, d: _shown(tree.tree_transform(li(s, d, 6), plan("months"))),
        "tree_level_1_events": lambda s, d: _level_states(s, d, 1),
        "tree_level_2_events": lambda s, d: _level_states(s, d, 2),
        "direct_events": lambda s, d: _rounded(direct.direct_transform(ev(s, d, 4), DIRECT, 64), "v"),
        "direct_masked_events": lambda s, d: _rounded(direct.direct_transform(ev(s, d, 4), DIRECT, 64, masked=(2,)), "v"),
        "waterfall_events": lambda s, d: ev(s, d, 7),
        "waterfall_lineitem": lambda s, d: _rounded(li(s, d, 6), "x"),
        "plan_shape": _shapes,
        "channel_grids": _channel_grids,
        "dm_grid": _dm_grid,
        "geometry_numbers": _numbers,
        "dm_list": lambda s, d: fn.dm_list(s, 20.0, 0.5, 1.0),
        "dm_range": lambda s, d: _rounded(pulse.dm_bounds(frames.trials(s, plan("odd"))), "dm_min", "dm_max"),
        "dm_delays": lambda s, d: fn.dm_delays(s, _P["dm"], _P["f_min"], _P["f_max"], _P["tsamp"], _P["nchans"]),
        "delay_table": lambda s, d: frames.delays(s, DIRECT),
        "closest_index": _closest,
        "add_offset": _add_offset,
        "copy_rows": _copy,
        "simulate_pulse": lambda s, d: pulse.simulate_pulse(s, **_P),
        "peak_search": lambda s, d: _shown(pulse.peak(tree.tree_transform(ev(s, d, 7), plan("odd")))).drop("dm"),
        "pulse_recovered": _recovered,
        "nearest_events": _nearest("nearest"),
        "events_before": _nearest("before"),
        "shipping_windows": _windows,
        "best_cells_embeddings": _best_cells,
        "tree_recording_embeddings": _recorded,
        "tree_sql_embeddings": _by_sql,
        "tree_stream_events": _streamed,
        "tree_level_1_blocks": lambda s, d: _level_blocks(s, d, 1),
        "tree_level_2_blocks": lambda s, d: _level_blocks(s, d, 2),
    }
    return out | whole_queries()


def oracle_sql() -> dict[str, str]:
    ev = wf_events_sql
    g = GEOMETRIES["odd"]
    out = {
        "tree_events": tree_sql("odd", ev(7)),
        "tree_flat_events": tree_sql("odd", ev(7)),
        "tree_lineitem": tree_sql("months", wf_lineitem_sql(6)),
        "direct_events": direct_sql(ev(4), 64),
        "direct_masked_events": direct_sql(ev(4), 64, (2,)),
        "waterfall_events": ev(7)[1:-1],
        "waterfall_lineitem": f"select chan, t, round(x, 6) as x from {wf_lineitem_sql(6)}",
        "plan_shape": _shapes_sql(),
        "channel_grids": _channel_grids_sql(),
        "dm_grid": _dm_grid_sql(),
        "geometry_numbers": _numbers_sql(),
        "dm_list": "select cast(range as integer) as i_dm, cast(1.0 + range * 0.5 as double) as dm from range(39)",
        "dm_range": f"select round(cast({g.dt_min} as double) * {g.dm_step!r}, 6) as dm_min, round(cast({g.dt_max} as double) * {g.dm_step!r}, 6) as dm_max",
        "dm_delays": DELAYS_SQL,
        "delay_table": _delay_table_sql(),
        "closest_index": CLOSEST_SQL,
        "add_offset": ADD_OFFSET_SQL,
        "copy_rows": COPY_SQL,
        "simulate_pulse": PULSE_SQL,
        "pulse_recovered": f"select i_dt, dt, dm, t, v from ({tree_sql('pulse', '(' + PULSE_SQL + ')')}) order by v desc, i_dt, t limit 1",
        "peak_search": f"select i_dt, dt, t, v from ({tree_sql('odd', ev(7))}) order by v desc, i_dt, t limit 1",
    }
    whole = whole_oracle_sql()
    out |= {
        "nearest_events": _nearest_sql("nearest"),
        "events_before": _nearest_sql("before"),
        "shipping_windows": WINDOWS_SQL,
        "best_cells_embeddings": f"select obs, i_dt, t, v, cast(place as integer) as place from (select obs, i_dt, t, v, row_number() over (partition by obs order by v desc, i_dt, t) as place from ({whole['tree_embeddings']})) where place <= 5",
        "tree_recording_embeddings": whole["tree_blocks_embeddings"],
        "tree_sql_embeddings": whole["tree_blocks_embeddings"],
        "tree_stream_events": out["tree_events"],
    }
    for i in (1, 2):
        out[f"tree_level_{i}_events"] = level_sql("odd", ev(7), i)
        out[f"tree_level_{i}_blocks"] = _level_blocks_sql(i)
    return out | whole


def _level_flat(name: str, upto: int) -> str:
    """The rows of a level, followed down to channels: i_sub, i_dt, chan, w, shift."""
    p = plan(name)
    top = p.levels[upto]
    rows = [(int(top.band[r]), int(top.index[r]), r, 0) for r in range(len(top.band))]
    for level in reversed(p.levels[1 : upto + 1]):
        down = []
        for b, i, r, s in rows:
            down.append((b, i, int(level.tail[r]), s))
            if level.head[r] >= 0:
                down.append((b, i, int(level.head[r]), s + int(level.offset[r])))
        rows = down
    base = p.levels[0]
    return _values([(b, i, int(base.band[r]), int(base.delay[r]), s) for b, i, r, s in rows], "i_sub, i_dt, chan, w, shift")


def level_sql(name: str, wf: str, upto: int) -> str:
    """The state after `upto` merges, by following rows down to channels."""
    g = GEOMETRIES[name]
    return f"""with wf as {wf}, flat as {_level_flat(name, upto)},
    m as (select f.i_sub, f.i_dt, f.chan, cast(a.t + f.shift as integer) as t, avg(b.x) as m from flat f join wf a on a.chan = f.chan and a.t >= f.w join wf b on b.chan = a.chan and b.t between a.t - f.w and a.t
          where a.t + f.shift < {g.nsamps} group by f.i_sub, f.i_dt, f.chan, a.t, f.shift)
    select cast(i_sub as integer) as i_sub, cast(i_dt as integer) as i_dt, t, round(sum(m), 6) as v from m group by all"""
