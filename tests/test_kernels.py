"""Kernels on arrays: fixed cases, brute force and properties."""

import itertools
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import chunking, frames, metrics, moments

VALUES = st.lists(st.floats(0, 1, allow_nan=False), min_size=1, max_size=9)


def group(n, seed=0, chunk=None):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(n, 8))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return frames.Group(rng.random(n), e, 2.0 * np.arange(n), 2.0 * n, chunk, None)


def test_mmr_fixed_case():
    e = np.array([[1, 0], [0.98, 0.199], [0, 1], [0.6, 0.8]])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    q = np.array([0.9, 0.4359])
    assert frames.mmr(frames.Group(e @ q / np.linalg.norm(q), e, 2.0 * np.arange(4), 8.0), 3) == [1, 3, 0]


@pytest.mark.parametrize("seed", range(4))
def test_mmr_against_plain_loops(seed):
    g = group(15, seed)
    out = [int(np.argmax(g.rel))]
    while len(out) < 6:
        score = [-np.inf if i in out else 0.7 * g.rel[i] - 0.3 * max(0.8 * g.emb[i] @ g.emb[s] + 0.2 * (1 - abs(g.t[i] - g.t[s]) / g.duration) for s in out) for i in range(15)]
        out.append(int(np.argmax(score)))
    assert frames.mmr(g, 6, 0.7, 0.2) == out


@pytest.mark.parametrize("method", sorted(frames.METHODS))
@pytest.mark.parametrize("n", [1, 3, 8])
def test_selectors_return_distinct_windows(method, n):
    chunk = np.array([0, 0, 0, 1, 1, 1, -1, 2, 2, 2, 2, 2])
    g = group(12, 5, chunk)
    g.best = [(int(w[np.argmax(g.rel[w])]), float(g.rel[w].max())) for w in (np.flatnonzero(chunk == c) for c in range(3))]
    got = frames.METHODS[method](g, n)
    assert len(set(got)) == len(got) <= max(n, 3) and all(0 <= k < 12 for k in got)


def test_allocation_fixed_case():
    assert frames.allocate(np.array([0.2, 0.5, 0.3]), np.array([9, 9, 9]), 7).tolist() == [2, 3, 2]


def test_smoothing_fixed_case():
    assert np.allclose(frames.edge_smoothed(np.array([1, 0, 4, 2, 6, 3]), 5), [1.4, 1.6, 2.6, 3, 3.6, 3.4])


@settings(max_examples=40, deadline=None)
@given(VALUES)
def test_penalized_runs_are_optimal(values):
    x = np.array(values, dtype=np.float32).astype(float)
    n, penalty = len(x), 0.1
    c = x - x.mean()

    def worth(flags):
        runs = [list(v) for k, v in itertools.groupby(range(n), key=lambda i: flags[i]) if k]
        return sum(c[r].sum() - penalty for r in runs)

    best = max(worth(f) for f in itertools.product((0, 1), repeat=n))
    got = moments.penalized_runs(x, np.arange(n), np.arange(n) + 1, penalty)
    assert sum(c[a : b + 1].sum() - penalty for a, b in got) == pytest.approx(max(best, 0), abs=1e-6)


@settings(max_examples=30, deadline=None)
@given(st.integers(4, 10), st.integers(0, 50), st.floats(0.01, 2))
def test_change_points_are_optimal(n, seed, penalty):
    e = np.random.default_rng(seed).normal(size=(n, 3))
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    cost = lambda a, b: (b - a) - (u[a:b].sum(axis=0) ** 2).sum() / (b - a)
    total = lambda cuts: sum(cost(a, b) + penalty for a, b in itertools.pairwise([0, *cuts, n]))
    every = [c for r in range(n) for c in itertools.combinations(range(1, n), r) if all(b - a >= 2 for a, b in itertools.pairwise([0, *c, n]))]
    got = [k + 1 for k in chunking.kernel_change_points(e, penalty, 2)]
    assert total(got) == pytest.approx(min(map(total, every)), abs=1e-9)


def test_merge_short_fixed_case():
    at, emb = chunking.merge_short([(0, 60, "stable"), (60, 90, "stable"), (90, 210, "stable"), (210, 240, "stable")], np.array([[1, 0], [0.8, 0.6], [0, 1], [0.6, 0.8]]), 30, 1.5)
    assert [c[:2] for c in at] == [(0, 90), (90, 240)] and np.allclose(emb, [[0.933333, 0.2], [0.12, 0.96]], atol=1e-6)


def test_boundary_matching_fixed_case():
    assert metrics.matched(np.array([2.1, 5.0]), np.array([2.0, 5.1, 9.0]), 0.5) == 2
    assert metrics.matched(np.array([1.0, 5.2, 8.9, 9.1]), np.array([2.0, 5.1, 9.0]), 0.5) == 2


def test_zero_variance_and_short_series():
    assert chunking.kernel_change_points(np.ones((3, 2)), None, 2) == []
    assert frames.segment_boundaries(np.ones(5)) in ([], [1], [1, 2, 3, 4])
    assert moments.penalized_runs(np.ones(4), np.arange(4), np.arange(4) + 1) == []


def test_allocate_gives_the_best_segments_one_frame_each():
    assert frames.allocate(np.array([5.0, 0.0, 0.0]), np.array([9, 9, 9]), 2).tolist() == [1, 1, 0]
    assert frames.allocate(np.array([0.0, 1.0, 3.0]), np.array([9, 9, 9]), 1).tolist() == [0, 0, 1]
    assert frames.allocate(np.array([1.0, 1.0]), np.array([9, 9]), 5, False).tolist() == [3, 2]


def test_weighted_looks_beside_chunks_without_windows():
    """Chunk 0 holds no window: the one nearest to its middle stands for it, and the other chunks keep their own."""
    g = group(6, 2, np.array([1, 1, 1, 2, 2, 2]))
    g.rel = np.array([0.1, 0.9, 0.2, 0.3, 0.8, 0.4])
    g.spans = [(-5.0, 0.0), (0.0, 6.0), (6.0, 12.0)]
    assert sorted(frames.weighted(g, 5)) == [0, 1, 2, 4, 5] or sorted(frames.weighted(g, 5)) == [0, 1, 2, 3, 4]
    assert frames.weighted(g, 3) == [0, 1, 4]
    assert sorted(frames.weighted(g, 2)) == [1, 4]
    assert len(frames.weighted(g, 6)) == 6


def test_stretch_probes_the_nearest_free_window_later_first():
    g = group(5)
    g.rel = np.array([0.0, 0.0, 1.0, 0.0, 0.0])
    assert frames.stretch(g, 3, 1.0) == [2, 3, 1]
    assert sorted(frames.stretch(g, 5, 1.0)) == list(range(5))


def test_uniform_topk_of_one_frame():
    g = group(3)
    g.rel = np.array([0.1, 0.9, 0.2])
    assert frames.uniform_topk(g, 1) == [1] and frames.uniform_topk(g, 2) == [0, 1]


@given(VALUES, st.integers(1, 4), st.floats(0.01, 0.5))
@settings(max_examples=60, deadline=None)
def test_penalized_runs_with_a_longest_duration(values, most, penalty):
    """Against all ways to choose runs of at most so many chunks."""
    x = np.array(values).astype(np.float32).astype(float)
    n, c = len(x), x - x.mean()
    best = np.zeros(n + 1)
    for j in range(1, n + 1):
        best[j] = max([best[j - 1], *(best[i] + c[i:j].sum() - penalty for i in range(max(0, j - most), j))])
    got = moments.penalized_runs(np.array(values), np.arange(n), np.arange(n) + 1, penalty, most=most)
    assert all(b - a < most for a, b in got) and all(p[1] < q[0] for p, q in itertools.pairwise(got))
    assert abs(sum(c[a : b + 1].sum() - penalty for a, b in got) - best[n]) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_coverage_against_plain_loops_in_blocks(seed, monkeypatch):
    """With copies, and blocks of a few windows."""
    monkeypatch.setattr(frames, "BLOCK", 90)
    g = group(40, seed)
    g.emb[20:30] = g.emb[:10]
    g.rel[20:30] = g.rel[:10]
    sims, reach, out = g.emb @ g.emb.T, np.full(40, -np.inf), []
    while len(out) < 9:
        gain = [-np.inf if k in out else round(np.maximum(reach, sims[:, k]).sum() + 0.5 * g.rel[k], 9) for k in range(40)]
        out.append(int(np.argmax(gain)))
        reach = np.maximum(reach, sims[:, out[-1]])
    assert frames.coverage(g, 9) == out


def test_coverage_holds_no_square_of_its_windows():
    g = group(6000, 1)
    tracemalloc.start()
    frames.coverage(g, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # the square has 288 MB
