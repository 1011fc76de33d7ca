"""Exact Jaccard within candidate groups, and connected components.

Candidate searches give star rows (hub, node): any two nodes of one hub may be
alike. A group becomes blocks of bounded size. In a task one matrix product
gives the exact intersections of all its sets, and only a spanning forest
leaves it, so no pair is ever a row. Each block is compared by itself and with
its hub first; only nodes that aren't connected by then meet across blocks. A
group that hangs together makes little more than a row for each node.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, lean, materialize, mix, rolling, slot, slots, text_keys, word_hashes, words

BLOCK = 1024  # nodes of a block
BLOCK_ITEMS = 4_000_000  # items of all its sets
COLUMNS = 2048  # items multiplied at a time
PART_ITEMS = 500_000  # items sorted at a time
BASE = 0x9E3779B97F4A7C15  # an odd multiplier
STRIP = 128  # rows compared at a time


def as_bytes(scalar) -> bytes:
    """An Arrow string as UTF-8; null is empty."""
    return scalar.as_buffer().to_pybytes() if scalar.is_valid and scalar.as_buffer() is not None else b""


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (fewer words than a shingle make one, none none); A-Z are lower-cased."""
    x = word_hashes(words(text.translate(LOWER_AZ)), 42)
    return np.unique(mix(rolling(x, min(shingle, len(x)), BASE))) if len(x) else x


def whole_sets(docs: DataFrame, nodes: DataFrame, shingle: int, repeated: bool = True) -> DataFrame:
    """node, set of nodes (node, first: doc_id, k1, k2 of a row that has the text). repeated: docs may have equal rows."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([shingle_set(as_bytes(t), shingle).tobytes() for t in batch["text"]], pa.binary())], ["node", "set"])

    needed = materialize(nodes.select("node", F.col("first.doc_id").alias("one"), F.col("first.k1").alias("n1"), F.col("first.k2").alias("n2")))
    texts = docs.select("doc_id", *text_keys(F.col("text")), "text")
    texts = texts.join(slots(needed, "n1"), slot("k1") == F.col("slot_"), "left_semi")
    texts = texts.join(needed, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("one")))
    sets = texts.select("node", "text").mapInArrow(lean(run), "node long, set binary")
    return materialize(sets.dropDuplicates(["node"]) if repeated else sets)


def block_count(m, items):
    return F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(items / BLOCK_ITEMS)).cast("long")


def group_sizes(candidates: DataFrame) -> DataFrame:
    """hub, blocks_ of groups of two nodes or more; n is the size of a node's set."""
    per = candidates.groupBy("hub").agg(F.count(F.lit(1)).alias("m_"), F.sum("n").alias("items_")).where("m_ > 1")
    return per.select("hub", block_count(F.col("m_"), F.col("items_")).alias("blocks_"))


def own_blocks(candidates: DataFrame, per: DataFrame) -> DataFrame:
    """(hub, node, n, ...) -> task, node, n, ...: a node's hash deals it to one block of its group; the hub's node, unless very long, goes to all, so that what is like it is connected at once."""
    everywhere = (F.col("node") == F.col("hub")) & (F.col("n") <= BLOCK_ITEMS // 8)
    dealt = F.when(everywhere, F.expr("sequence(0L, blocks_ - 1)")).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks_"))))
    rows = candidates.join(per, "hub").withColumn("b_", F.explode(dealt))
    return rows.select(F.xxhash64("hub", "b_").alias("task"), *[c for c in candidates.columns if c != "hub"])


def blocks_across(candidates: DataFrame, per: DataFrame) -> DataFrame:
    """(hub, node, n, label, ...) -> task, node, n, label, ...: in groups of several blocks, each two nodes of different labels share a task.

    The commonest label of a group is its main one. Blocks of other nodes meet
    each other and the main blocks, main blocks don't meet: a group of n nodes
    of which k have other labels makes about 2 n k rows for every BLOCK of
    them, none if all have one label.
    """
    rows = candidates.join(per.where("blocks_ > 1").select("hub"), "hub")
    parts = rows.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("m_"), F.sum("n").alias("items_"))
    heads = parts.groupBy("hub").agg(F.max(F.struct("m_", "label", "items_")).alias("main_"), F.sum("m_").alias("m_"), F.sum("items_").alias("items_")).where("m_ > main_.m_")
    mains, others = block_count(F.col("main_.m_"), F.col("main_.items_")), block_count(F.col("m_") - F.col("main_.m_"), F.col("items_") - F.col("main_.items_"))
    rows = rows.join(heads.select("hub", F.col("main_.label").alias("main_"), mains.alias("mains_"), others.alias("others_")), "hub")
    rows = rows.withColumn("b_", F.pmod(F.xxhash64("node"), F.when(F.expr("label = main_"), F.col("mains_")).otherwise(F.col("others_"))))
    of_main = F.expr("transform(sequence(0L, others_ - 1), o -> xxhash64(hub, 0, o, b_))")
    of_other = F.expr(
        "concat(transform(sequence(0L, mains_ - 1), m -> xxhash64(hub, 0, b_, m)),"
        " transform(filter(sequence(0L, others_ - 1), o -> o <> b_), o -> xxhash64(hub, 1, least(o, b_), greatest(o, b_))))"
    )
    tasks = F.explode(F.when(F.expr("label = main_"), of_main).otherwise(of_other)).alias("task")
    return rows.select(tasks, *[c for c in candidates.columns if c != "hub"])


def by_task(df: DataFrame, body: Callable, columns: list[str], schema: str) -> DataFrame:
    """body(task, *columns of its rows as lists) -> arrays, for all tasks; rows of a task lie in one partition, side by side."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        held = []
        task = None

        def flush():
            if held:
                got = body(task, *([x for part in held for x in part[i]] for i in range(len(columns))))
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch["task"].to_numpy()
            cut = np.flatnonzero(np.diff(key)) + 1
            cols = [batch[c].to_pylist() for c in columns]
            for b, e in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                if key[b] != task:
                    yield from flush()
                    held, task = [], key[b]
                held.append([c[b:e] for c in cols])
        yield from flush()

    return df.select("task", *columns).repartition("task").sortWithinPartitions("task").mapInArrow(lean(run), schema)


def starts(sorted_: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    out = np.ones(len(sorted_), dtype=bool)
    out[1:] = sorted_[1:] != sorted_[:-1]
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets of distinct integers (exact: they stay below 2^24)."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    parts = -(-len(h) // PART_ITEMS)
    if parts < 2:
        _add_shared(out, h, owner)
        return out
    # equal items have equal remainders: what sorting takes is that of a part, not of the block
    part = (h % h.dtype.type(parts)).astype(np.uint16)
    for p in range(parts):
        mine = part == p
        _add_shared(out, h[mine], owner[mine])
    return out


def _add_shared(out: np.ndarray, h: np.ndarray, owner: np.ndarray) -> None:
    """Adds to out[a, b] the number of items that a and b share; owner: whose item each of h is."""
    m = len(out)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    item = np.cumsum(starts(h)) - 1
    shared = np.bincount(item)[item] > 1
    item, owner = item[shared], owner[shared]
    item = np.cumsum(starts(item)) - 1
    width = min(COLUMNS, int(item[-1]) + 1 if len(item) else 0)
    for at in range(0, int(item[-1]) + 1 if len(item) else 0, width or 1):
        lo, hi = np.searchsorted(item, (at, at + width))
        hot = np.zeros((m, width), dtype=np.float32)
        hot[owner[lo:hi], item[lo:hi] - at] = 1
        out += hot @ hot.T


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, other) positions: every component of a symmetric matrix of links as a star around its first member."""
    m = len(linked)
    label = np.arange(m)
    while True:
        now = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1, initial=m))
        now = now[now]
        if (now == label).all():
            break
        label = now
    other = np.flatnonzero(label != np.arange(m))
    return label[other], other


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs have a Jaccard of `similarity` or more; two empty sets have."""
    n = np.array([len(s) for s in sets], dtype=np.float64)
    both = intersections(sets).astype(np.float64)
    out = both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def linked(blocks: DataFrame, similarity: float) -> DataFrame:
    """(task, node, set) -> (u, v): links that connect all nodes of a task whose sets (64-bit, sorted, as bytes) are alike."""

    def body(task, node, raw):
        u, v = forest(alike([np.frombuffer(x, np.uint64) for x in raw], similarity))
        node = np.array(node, dtype=np.int64)
        return node[u], node[v]

    return by_task(blocks, body, ["node", "set"], "u long, v long")


def survivors(blocks: DataFrame, probable: Callable, columns: list[str]) -> DataFrame:
    """(task, node, label, n, columns) -> distinct (task, node): what hangs together in a task by pairs of different labels that may be alike, as probable(n, columns) says."""

    def body(task, node, label, n, *rest):
        node, label = np.array(node, dtype=np.int64), np.array(label, dtype=np.int64)
        first, other = forest(probable(np.array(n, dtype=np.float64), *rest) & (label[:, None] != label[None, :]))
        tasks, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for f in np.unique(first):
            part = np.sort(node[[f, *other[first == f]]])
            # the same sets meet at several hubs: equal parts have one number
            tasks.append(np.full(len(part), xxhash.xxh64_intdigest(part.tobytes()), dtype=np.uint64).view(np.int64))
            nodes.append(part)
        return np.concatenate(tasks), np.concatenate(nodes)

    return by_task(blocks, body, ["node", "label", "n", *columns], "task long, node long").distinct()


def sizes_fit(n: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets may be alike by their sizes."""
    out = np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :]) - 1e-9
    np.fill_diagonal(out, False)
    return out


def connected(groups: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], probable: Callable, similarity: float) -> DataFrame:
    """node, label (smallest node reachable) for nodes with a link: two nodes of one group (hub, node) whose sets have Jaccard `similarity` or more.

    nodes: node, n (size of the set) and what probable(n, ...) wants; sets(some
    nodes): node, set. Each block is compared within itself and with its hub
    first. Then only nodes that aren't connected yet meet across blocks: the
    links of pairs that are connected already would change nothing.
    """
    columns = [c for c in nodes.columns if c not in ("node", "n")]
    rows = groups.select("hub", "node").join(nodes, "node")
    per = materialize(group_sizes(rows))

    def links(blocks):
        parts = materialize(survivors(blocks, probable, columns))
        return linked(parts.join(sets(parts.select("node").distinct()), "node"), similarity)

    label = components(links(own_blocks(rows, per).withColumn("label", F.col("node"))))
    if per.where("blocks_ > 1").isEmpty():
        return label
    label = materialize(label)
    of = label.withColumnRenamed("node", "of")
    rows = rows.join(of, F.col("node") == F.col("of"), "left").drop("of").withColumn("label", F.coalesce("label", "node"))
    more = materialize(links(blocks_across(rows, per)))
    if more.isEmpty():
        return label
    return components(more.union(label.where("node <> label").select("node", "label")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label (smallest node reachable) for every node of edges (u, v), by large-star and small-star rounds."""
    e = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def sign(x):
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = sign(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select(F.col("v").alias("a"), F.col("u").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select("m", F.col("b").alias("v")).where("m <> v").union(low.select("m", F.col("a").alias("v"))).distinct()
        e = materialize(small.select(F.col("m").alias("u"), "v"))
        now = sign(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("label")).union(e.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
