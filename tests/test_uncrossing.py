"""Uncrossing with swaps: pins stay, the cap holds, crossings never rise, and crossings over a pin go."""

import numpy as np
import pytest

from lumafold.operators import ordering


def test_swap_changes_equal_recounted_lengths():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 20, (9, 2)).astype(float)
    d = np.linalg.norm(points[:, None] - points[None], axis=-1)
    order = list(range(9))
    change, longest = ordering._swaps(d)
    length = lambda o: sum(d[a, b] for a, b in zip(o, o[1:]))
    for i in range(9):
        for j in range(i + 2, 9):
            new = ordering._swapped(order, i, j)
            assert change[i, j] == pytest.approx(length(new) - length(order))
            links = [d[new[k], new[k + 1]] for k in range(8) if {k, k + 1} & {i, j}]
            assert longest[i, j] == pytest.approx(max(links))


@pytest.mark.parametrize("seed", range(12))
def test_crossings_never_rise(seed):
    rng = np.random.default_rng(seed)
    n = 16
    points = np.unique(rng.integers(0, 30, (n, 2)), axis=0).astype(float)
    n = len(points)
    order = list(rng.permutation(n).tolist())
    scale, pins = (1.0, 0.4), {0, n // 2, n - 1}
    cap = float(ordering.path_steps(ordering.step_lengths(points, scale), order).max())
    out = ordering.uncrossed(points, scale, order, cap, pins)
    assert sorted(out) == sorted(order) and all(out[p] == order[p] for p in pins)
    assert ordering.path_steps(ordering.step_lengths(points, scale), out).max() <= cap + 1e-9
    assert len(ordering.crossing_pairs(points[out])) <= len(ordering.crossing_pairs(points[order]))


def test_a_crossing_over_a_pin_goes():
    """The places on both sides of a pinned middle should trade, which no reversal between pins can do."""
    points = np.array([[-6, 0], [-3, 0], [1, 2], [0, 0], [-1, 2], [3, 0], [6, 0]], float)
    order = list(range(7))
    assert ordering.crossing_pairs(points[order])
    out = ordering.uncrossed(points, (1.0, 1.0), order, 20.0, {0, 3, 6})
    assert not ordering.crossing_pairs(points[out]) and [out[k] for k in (0, 3, 6)] == [0, 3, 6]


def test_swaps_help(monkeypatch):
    """Over random paths with a pinned middle, fewer crossings are left than by reversals alone."""

    def left() -> int:
        total = 0
        for seed in range(20):
            rng = np.random.default_rng(100 + seed)
            points = rng.permutation(np.stack(np.meshgrid(np.arange(5), np.arange(5)), -1).reshape(-1, 2))[:12].astype(float)
            out = ordering.uncrossed(points, (1.0, 1.0), list(range(12)), 9.0, {0, 6, 11})
            total += len(ordering.crossing_pairs(points[out]))
        return total

    with_swaps = left()
    monkeypatch.setattr(ordering, "_swaps", lambda d: (np.zeros_like(d), np.full_like(d, np.inf)))
    assert with_swaps < left()
