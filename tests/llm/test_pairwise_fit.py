"""The fit of preference pairs against a plain recomputation: a zero gradient, and the cut at the bad share's quantile."""

import numpy as np
import pytest

from lumafold.llm import pairwise_quality


@pytest.mark.parametrize("ties", [False, True])
def test_weights_are_the_minimum_and_the_cut_is_a_quantile(ties):
    rng = np.random.default_rng(7)
    good = rng.random(80) < 0.6
    raw = rng.normal(size=(80, 3)) + good[:, None] * 0.7
    if ties:
        raw = np.round(raw)  # many equal rows, on either side
    pairs, ridge, seed = 400, 1e-2, 5
    model = pairwise_quality.fit(raw, good, pairs=pairs, ridge=ridge, seed=seed)
    x = model.expand(raw)
    draws = np.random.default_rng(seed).choice(np.flatnonzero(good), pairs)
    losers = np.flatnonzero(~good)

    def loss(w):
        return sum(np.log1p(np.exp(-float(w @ (x[a] - x[losers[k % len(losers)]])))) for k, a in enumerate(draws)) / pairs + ridge / 2 * float(w @ w)

    least = loss(model.weights)
    slopes = [(loss(model.weights + 1e-5 * e) - loss(model.weights - 1e-5 * e)) / 2e-5 for e in np.eye(len(model.weights))]
    assert np.abs(slopes).max() < 1e-5
    assert all(loss(model.weights + 0.05 * rng.normal(size=len(model.weights))) > least for _ in range(5))
    strength = np.sort(x @ model.weights)
    n = len(losers)
    assert strength[n - 1] - 1e-9 <= model.cut <= strength[n] + 1e-9
    score = model.score(raw)
    assert ((score > 0) & (score < 1)).all()
    assert (np.argsort(score, kind="stable") == np.argsort(np.clip(x @ model.weights - model.cut, -30, 30), kind="stable")).all() or ties
    if not ties:
        assert (score < 0.3).sum() == n  # as many below the threshold as are labelled bad
