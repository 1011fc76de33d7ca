"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Words are dealt to shards of a source, a shard's words are cut into blocks of
equal length (they differ by one word at most), and integer numbers of blocks
go to sources, then to the shards of a source, by highest quotients
weight / (2 s + 1). In a shard that gets q of B blocks, every block is taken
q div B times, and q mod B blocks once more; those are picked by a seeded
permutation k -> (a k + c) mod B.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

BLOCK = 64
SHARD_WORDS = 65_536
MAX_SHARDS = 16_384
def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: list[int], share: tuple[int, int], cap: int) -> DataFrame:
    """source, source_size -> + w, target: water-filling of share of all words by weight, at most cap times a source.

    One row per source, so the windows over all of them stay small.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    arr = F.array(*[F.lit(w) for w in weights])
    t = totals.withColumn("w", F.element_at(arr, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    # sources in the order in which the rising level caps them
    rise = Window.orderBy((F.col("source_size") / F.col("w")), F.asc_nulls_last("source"))
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("twice", F.lit(share[0]) * F.sum("source_size").over(everything)).withColumn("w_all", F.sum("w").over(everything))
    t = t.withColumn("cap_before", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    rest, wrest = F.col("twice") - share[1] * F.col("cap_before"), F.col("w_all") - F.col("w_before")
    t = t.withColumn("capped", (share[1] * cap * F.col("source_size") * wrest <= F.col("w") * rest).cast("int"))
    # the level is that of the first source that isn't capped
    first = F.when(F.col("capped") == 0, F.struct(F.col("w_before"), rest.alias("rest"), wrest.alias("wrest")))
    t = t.withColumn("level", F.min(first).over(everything))
    t = t.withColumn("target", F.when((F.col("capped") == 1) | F.col("level").isNull(), (F.col("source_size") * cap).cast("double")).otherwise(F.col("w") * F.col("level.rest") / (share[1] * F.col("level.wrest"))))
    return t.select("source", "source_size", "target")


def apportion(units: DataFrame, by: list[str], seats: str, weight: str, most: str, order: list[str]) -> DataFrame:
    """Adds q: `seats` seats within each group `by`, by highest quotients weight / (2 s + 1), at most `most` a unit.

    No unit's share of the seats may be above its `most` (targets() sees to that).
    Divisors (sum + n/2) and (sum - n/2) bracket the last quotient, so only
    about two quotients a unit are ranked.
    """
    g = Window.partitionBy(*by)
    u = units.withColumn("n_", F.count(F.lit(1)).over(g)).withColumn("sum_", F.sum(weight).over(g))
    s = F.col(seats)
    lo = F.when(s > F.col("n_") / 2, F.floor(F.col(weight) * (s - F.col("n_") / 2) / F.col("sum_") + 0.5 - 1e-9)).otherwise(0)
    hi = F.floor(F.col(weight) * (s + F.col("n_") / 2) / F.col("sum_") + 0.5 + 1e-9) + 1
    u = u.withColumn("lo_", F.coalesce(F.least(F.greatest(lo, F.lit(0)), F.col(most)), F.lit(0)).cast("long"))
    u = u.withColumn("hi_", F.coalesce(F.least(hi, F.col(most)), F.lit(0)).cast("long"))
    u = u.withColumn("free_", s - F.sum("lo_").over(g))
    more = u.where("hi_ > lo_").withColumn("s_", F.explode(F.sequence(F.col("lo_"), F.col("hi_") - 1)))
    rank = Window.partitionBy(*by).orderBy((F.col(weight) / (2 * F.col("s_") + 1)).desc(), *[F.asc_nulls_last(c) for c in order], "s_")
    won = more.withColumn("r_", F.row_number().over(rank)).where("r_ <= free_").groupBy(*[F.col(c).alias(f"{c}_k") for c in order]).agg(F.count(F.lit(1)).alias("won_"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in order]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return u.join(won, cond, "left").withColumn("q", F.col("lo_") + F.coalesce("won_", F.lit(0))).drop("n_", "sum_", "lo_", "hi_", "free_", "won_", *[f"{c}_k" for c in order])


def multiplier(seed: int, n: Column, *key: str) -> Column:
    """A seeded number below n that has no factor in common with it: the first such of 64 draws (1 if none is)."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(F.xxhash64(F.lit(seed), i, *key), n))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] != 0, s["x"] % s["y"]).otherwise(F.lit(0).cast("long")).alias("y")))
    gcd = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(x.alias("x"), n.cast("long").alias("y")), step)["x"]
    return F.coalesce(F.try_element_at(F.filter(draws, lambda x: gcd(x) == 1), F.lit(1)), F.lit(1).cast("long"))


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, seed: int = 42, keep: list[str] = ()) -> DataFrame:
    """doc_id, source, k1, size, source_size, target, taken, shard and runs (words lo..hi - 1 of a block, and how often they are taken) of each row.

    share = (3, 2): 150 % of all words are asked for. Columns other than
    doc_id, text and source are ignored. Null text counts no words; null source
    is a source of its own (last); no rows give no rows; repeated rows are rows
    of their own (as equal rows they may swap what is taken from them).
    """
    spark = docs.sparkSession
    d = materialize(docs.select("doc_id", "source", F.xxhash64("text").alias("k1"), n_words(F.col("text")).alias("size")))
    t = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, cap)
    t = materialize(t.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(max_shards), F.ceil(F.col("source_size") / shard_words))).cast("long")))
    # one row per source: broadcast while the table is small, joined by key beyond
    small = t.count() <= 100_000
    side = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    tt = t.withColumnRenamed("source", "source_t")
    d = d.join(side(tt), F.col("source").eqNullSafe(F.col("source_t")), "left").drop("source_t")
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k1"), F.col("shards")))
    w = Window.partitionBy("source", "shard")
    d = d.withColumn("first_word", F.sum("size").over(w.orderBy("doc_id", "k1", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    units = d.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    units = units.where("words > 0").withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long"))
    units = materialize(units.withColumn("weight", F.col("target") / F.col("source_size") * F.col("blocks")))
    src = units.groupBy("source").agg(F.sum("blocks").alias("b"), F.sum("weight").alias("wt")).withColumn("one", F.lit(1))
    src = src.withColumn("most", F.col("b") * cap).withColumn("seats", F.round(F.sum("wt").over(Window.partitionBy())).cast("long"))
    src = apportion(src, ["one"], "seats", "wt", "most", ["source"]).select(F.col("source").alias("source_s"), F.col("q").alias("source_q"))
    units = units.join(src, F.col("source").eqNullSafe(F.col("source_s"))).drop("source_s").withColumn("most", F.col("blocks") * cap)
    units = apportion(units, ["source"], "source_q", "weight", "most", ["source", "shard"])
    units = units.select(F.col("source").alias("source_u"), F.col("shard").alias("shard_u"), "words", "blocks", "q", multiplier(seed, F.col("blocks"), "source", "shard").alias("a"), F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.col("blocks")).alias("c"))
    d = d.join(units, F.col("source").eqNullSafe(F.col("source_u")) & (F.col("shard") == F.col("shard_u")), "left").drop("source_u", "shard_u")
    # block k of a shard holds words floor(k W / B) .. floor((k + 1) W / B) - 1
    d = d.withColumn("runs", F.expr("""
        case when size = 0 or blocks is null then cast(array() as array<struct<lo:bigint,hi:bigint,times:bigint>>) else
        transform(sequence((first_word * blocks) div words, least(blocks - 1, ((first_word + size - 1) * blocks) div words + 1)), k -> struct(
            greatest(0L, (k * words + blocks - 1) div blocks - first_word) as lo,
            least(size, ((k + 1) * words + blocks - 1) div blocks - first_word) as hi,
            q div blocks + if((k * a + c) % blocks < q % blocks, 1L, 0L) as times)) end"""))
    d = d.withColumn("taken", F.expr("aggregate(runs, 0L, (s, x) -> s + greatest(0L, x.hi - x.lo) * x.times)"))
    return d.select("doc_id", "source", "k1", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "taken", "shard", "runs")


def op1(spark, sf_dir):
    """doc_id, source, size, source_size, target, taken of all documents, as mix() defines them."""
    from .common import documents

    return mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def all_targets(spark, sf_dir):
    """source, source_size, target of all documents: the part of op1 that SQL can check."""
    from .common import documents

    sizes = documents(spark, sf_dir).groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    return targets(sizes, [3, 1, 2], (3, 2), 2).select("source", "source_size", F.round("target", 6).alias("target"))


TARGETS_SQL = r"""
with t as (select source, cast(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as bigint) as source_size from documents group by source),
r as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from t),
o as (select *, sum(source_size) over () * 1.5 as asked, sum(w) over () as all_w, coalesce(sum(2 * source_size) over before, 0) as capped, coalesce(sum(w) over before, 0) as capped_w
      from r window before as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (asked - capped) / (all_w - capped_w) as level from o)
select source, source_size, round(least(2.0 * source_size, w * coalesce((select level from l where w * level < 2 * source_size order by source_size / w, source nulls last limit 1), 1e300)), 6) as target from l
"""


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row for each pass over a document, with the words of the blocks taken in that pass.

    A whole document keeps its text as it is; of a cut one, words keep the white
    space behind them. Rows equal in doc_id, source and text take the same blocks
    (so only of tables without repeated rows the words are those of mix()). Null
    and empty texts have no words and go; no rows give no rows. Columns that
    begin with mx_ raise.
    """
    names = docs.columns
    if any(c.lower().startswith("mx_") for c in names):
        raise ValueError("columns that begin with mx_ are made here: rename those of docs")
    m = mix(docs, **how).where("taken > 0")
    m = m.select(F.col("doc_id").alias("mx_id"), F.col("source").alias("mx_source"), F.col("k1").alias("mx_key"), F.col("runs").alias("mx_runs"), F.col("size").alias("mx_size")).dropDuplicates(["mx_id", "mx_source", "mx_key"])
    d = docs.withColumn("mx_k1", F.xxhash64("text"))
    d = d.join(m, d.doc_id.eqNullSafe(F.col("mx_id")) & (F.col("mx_k1") == F.col("mx_key")) & d.source.eqNullSafe(F.col("mx_source")))
    d = d.withColumn("mx_pass", F.explode(F.sequence(F.lit(1), F.expr("aggregate(mx_runs, 0L, (s, x) -> greatest(s, x.times))").cast("int"))))
    d = d.withColumn("mx_runs", F.expr("filter(mx_runs, x -> x.times >= mx_pass and x.hi > x.lo)")).where(F.size("mx_runs") > 0)
    whole = F.expr("aggregate(mx_runs, 0L, (s, x) -> s + x.hi - x.lo)") == F.col("mx_size")
    d = d.withColumn("mx_parts", F.when(~whole, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))))
    cut = F.expr("rtrim(array_join(flatten(transform(mx_runs, x -> slice(mx_parts, cast(x.lo + 1 as int), cast(x.hi - x.lo as int)))), ''))")
    d = d.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in names:
        d = d.withColumn("n_chars", F.length("text").cast("long"))
    return d.select(*names)
