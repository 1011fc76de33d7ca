"""What workers hold: an executor's limit is for its heap and its workers together."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import tokenizers

from chirpsieve.llm import groups


def test_a_full_block_is_not_sorted_at_once():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 70_000, dtype=np.uint64)
    sets = [np.unique(base[rng.random(len(base)) < 0.8]) for _ in range(48)]
    items = sum(map(len, sets))
    assert items > 5 * 500_000
    tracemalloc.start()
    try:
        got = groups.intersections(sets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for a, b in ((0, 1), (5, 40), (12, 3)):
        assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))
    assert peak < 30 * items, f"{peak / items:.0f} bytes an item"


def test_parts_give_the_same_intersections(monkeypatch):
    rng = np.random.default_rng(2)
    for kind in (np.uint64, np.int64):
        sets = [np.unique(rng.integers(0, 300, int(rng.integers(0, 120))).astype(kind)) for _ in range(40)]
        want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        for size in (1, 7, 100, 10**6):
            monkeypatch.setattr(groups, "PART_ITEMS", size)
            assert (groups.intersections(sets) == want)[~np.eye(len(sets), dtype=bool)].all()


class Asked:
    """Stands for a DataFrame: runs what mapInArrow gets in this process."""

    def __getattr__(self, name):
        return lambda *a, **b: self

    def mapInArrow(self, run, schema):  # noqa: N802
        list(run(iter([pa.RecordBatch.from_pydict({c.split()[0]: pa.array([], pa.int64()) for c in ("task", "node", "set")})])))
        return self


def test_comparing_tasks_drop_the_word_memory_of_packing(monkeypatch):
    monkeypatch.setitem(tokenizers.__dict__, "chirpsieve_encoders", {"vocabulary": object()})
    groups.linked(Asked(), 0.8)
    assert not tokenizers.chirpsieve_encoders
