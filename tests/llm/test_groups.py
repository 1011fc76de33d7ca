"""Candidate groups of several blocks: which nodes meet, how many rows that takes, and the components of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpsieve.llm import groups


def test_connected_nodes_do_not_meet_again(spark):
    n = 20_000
    one = spark.range(n).select(F.lit(0).cast("long").alias("hub"), F.col("id").alias("node"), F.lit(56).alias("n"), F.lit(0).cast("long").alias("label"))
    per = groups.group_sizes(one)
    assert per.first().blocks_ == 20
    own = groups.own_blocks(one, per)
    assert own.count() == n + 19 and own.where("node = 0").count() == 20
    assert groups.blocks_across(one, per).count() == 0
    k = 30
    some = one.withColumn("label", F.when(F.col("node") >= n - k, F.col("node")).otherwise(0))
    assert groups.blocks_across(some, per).count() == n - k + 20 * k  # 20 main blocks, one of the others


def test_nodes_of_different_labels_meet(spark, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK", 16)
    r = np.random.default_rng(4)
    label = np.concatenate([np.zeros(90, int), r.integers(1, 9, 60), np.arange(100, 150)])
    df = spark.createDataFrame([(7, i, 5, int(x)) for i, x in enumerate(label)], "hub long, node long, n int, label long")
    small = spark.createDataFrame([(8, 1000 + i, 5, i) for i in range(3)], "hub long, node long, n int, label long")
    both = df.union(small)
    per = groups.group_sizes(both)
    tasks = {}
    for x in groups.blocks_across(both, per).collect():
        tasks.setdefault(x.node, set()).add(x.task)
    assert set(tasks) == set(range(200))  # the small group is one block: all met before
    for i in range(200):
        for j in range(i):
            assert label[i] == label[j] or tasks[i] & tasks[j]


def brute(sets):
    """The least member of each text's component, by dense products of all pairs in strips."""
    items = {}
    for s in sets:
        for x in s:
            items.setdefault(x, len(items))
    hot = np.zeros((len(sets), len(items)), dtype=np.float32)
    for i, s in enumerate(sets):
        hot[i, [items[x] for x in s]] = 1
    size, label = hot.sum(1), np.arange(len(sets))
    links = []
    for at in range(0, len(sets), 500):
        both = hot[at : at + 500] @ hot.T
        u, v = np.nonzero(both >= 0.8 * (size[at : at + 500, None] + size[None, :] - both) - 1e-6)
        links.append((u + at, v))
    u, v = (np.concatenate(x) for x in zip(*links))
    while True:
        now = label.copy()
        np.minimum.at(now, u, label[v])
        now = now[now]
        if (now == label).all():
            return label
        label = now


@pytest.mark.parametrize("members", [3000])
def test_one_large_family(spark, members, monkeypatch):
    """Copies with few and with many edits: a large component, small ones beside it, texts that are near none."""
    from chirpsieve.llm.minhash import near_duplicates
    from chirpsieve.llm.simhash import dedup

    r = np.random.default_rng(21)
    base = [f"w{x}" for x in range(80)]
    texts = []
    for _ in range(members):
        w = list(base)
        # whole phrases of a few variants, so that texts apart from the base are near each other
        for at in r.integers(0, 8, int(r.choice([0, 1, 1, 2, 3]))):
            w[at * 10 + 2 : at * 10 + 5] = [f"v{at}.{r.integers(0, 6)}"] * 3
        if r.random() < 0.5:
            w[int(r.integers(0, 80))] = f"e{r.integers(0, 10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = brute(sets)
    want = sorted(set(label.tolist()))
    assert 20 < len(want) < members // 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    monkeypatch.setattr(groups, "BLOCK", 128)
    assert sorted(x.doc_id for x in dedup(df).collect()) == want
    assert {x.doc_id: x.component_id for x in near_duplicates(df).collect()} == dict(enumerate(label.tolist()))
