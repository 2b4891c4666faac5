"""Large groups of near copies: what a task holds is bounded, and the join stays exact."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_operators import brute_links

from pathledger.llm import jaccard_join


def near_copies(n, size=400, changed=60, seed=3):
    r = np.random.default_rng(seed)
    core = r.integers(0, 2**62, size).astype(np.uint64)
    sets = []
    for _ in range(n):
        s = core.copy()
        k = r.integers(0, changed)
        s[r.integers(0, size, k)] = r.integers(0, 2**62, k).astype(np.uint64)
        sets.append(np.unique(s))
    return sets


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def chunk(sets, held, last=True):
    """A batch of one chunk: its first `held` sets are pivots, and all are members."""
    rows = [*range(held), *range(len(sets))]
    first = [True] * held + [False] * len(sets)
    el = pa.array([sets[i].view(np.int64) for i in rows], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([7] * len(rows)), pa.array([0] * len(rows)), pa.array(first), pa.array(rows), pa.array(rows), el, pa.array([last] * len(rows))], ["cell", "chunk", "pivot", "doc_id", "label", "el", "last"])


@pytest.mark.parametrize("last, held", [(True, 500), (False, 16)])
def test_a_chunk_of_near_copies_stays_small(last, held):
    """Counting what 500 sets share with 500 took 2,109 MB, and every linked pair was a row."""
    sets = near_copies(500)
    out, most = peak(lambda: list(jaccard_join._deal(80, 0)(iter([chunk(sets, held, last)]))))
    assert most < 100 << 20
    links = [(a, b) for x in out for a, b in zip(x.column(1).to_pylist(), x.column(3).to_pylist()) if b is not None]
    assert len(links) <= len(sets) + held
    assert len(links) == len({tuple(sorted(x)) for x in links})
    if last:
        root = list(range(len(sets)))
        for a, b in links:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        want = brute_links({i: set(s.tolist()) for i, s in enumerate(sets)}, 80)
        assert dict(enumerate(root)) == want
        assert 1 < len(set(want.values())) < len(sets)


def test_a_large_cell_that_windows_cannot_divide(monkeypatch):
    sets = near_copies(300, changed=150, seed=4)
    s = jaccard_join.Sets(list(range(300)), sets, 80)
    _, most = peak(lambda: s.leaf(np.arange(300)))
    assert most < 100 << 20
    assert dict(enumerate(b for _, b in s.edges())) == brute_links({i: set(x.tolist()) for i, x in enumerate(sets)}, 80)


@pytest.mark.parametrize("m", [1, 7, 16, 70, 300])
def test_distances_to_a_block_are_exact(m, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE", 1000)
    sets, others = near_copies(m, size=90, changed=80, seed=m), [*near_copies(40, size=90, changed=80, seed=m), np.array([5], np.uint64)]
    block = jaccard_join.Block(list(range(m)), list(range(m)), sets)
    got = block.shared(np.concatenate(others), np.concatenate([[0], np.cumsum([len(x) for x in others])]))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets] for x in others]


def test_keys_of_a_large_batch_are_made_in_slices():
    """1.6 million elements in a batch took 133 MB."""
    sets = [s for k in range(4) for s in near_copies(100, size=4000, changed=300, seed=k)]
    el = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), el], ["doc_id", "el"])

    def run():
        return sum(x.num_rows for x in jaccard_join._keys(80)(iter([batch])))

    n, most = peak(run)
    doc, _ = jaccard_join.part_keys(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 80)
    assert n == len(doc)
    assert most < 64 << 20
