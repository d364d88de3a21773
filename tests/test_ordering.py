from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumafold.operators import lattice, ordering, schedule

ROWS = [0, 2, 5, 6]
COLUMNS = [[0, 1, 8], [2, 9], [0, 7], [3]]


@pytest.mark.parametrize("objective,fold", [("sum", sum), ("max", max)])
def test_row_directions_are_exact(objective, fold):
    best = min(fold(ordering.row_links(ROWS, COLUMNS, list(w))) for w in product("FB", repeat=4))
    assert fold(ordering.row_links(ROWS, COLUMNS, ordering.row_directions(ROWS, COLUMNS, objective=objective))) == best
    with pytest.raises(ValueError):
        ordering.row_directions(ROWS, COLUMNS, objective="mean")


def test_hill_climb_never_worse():
    rng = np.random.default_rng(0)
    for _ in range(20):
        columns = [sorted(rng.choice(20, rng.integers(1, 5), replace=False).tolist()) for _ in range(6)]
        first = max(ordering.row_links(list(range(6)), columns, ordering.row_directions(list(range(6)), columns)))
        assert max(ordering.row_links(list(range(6)), columns, ordering.best_directions(list(range(6)), columns))) <= first


@pytest.mark.parametrize("seed", [2, 4])
def test_paths_near_brute_force(seed):
    points = np.random.default_rng(seed).uniform(0, 20, (6, 2))
    d = ordering.step_lengths(points)
    best = min(ordering.path_steps(d, list(o)).sum() for o in permutations(range(6)))
    found = min((ordering.shorter_path(d, ordering.nearest_tour(d, s)) for s in range(6)), key=lambda o: ordering.path_steps(d, o).sum())
    assert ordering.path_steps(d, found).sum() <= best * 1.02


def test_bottleneck_never_worse_and_bounded():
    rng = np.random.default_rng(3)
    for _ in range(20):
        d = ordering.step_lengths(rng.uniform(0, 30, (15, 2)), (1, 1.3))
        first = ordering.shorter_path(d, ordering.nearest_tour(d))
        second = ordering.lower_bottleneck(d, first)
        assert sorted(second) == list(range(15))
        assert ordering.tree_bottleneck(d) - 1e-9 <= ordering.path_steps(d, second).max() <= ordering.path_steps(d, first).max() + 1e-9


def test_uncrossing():
    rng = np.random.default_rng(5)
    for _ in range(10):
        p = rng.uniform(0, 10, (12, 2))
        order = list(range(12))
        cap = ordering.path_steps(ordering.step_lengths(p), order).max()
        out = ordering.uncrossed(p, (1, 1), order, cap, {0, 5, 11})
        assert sorted(out) == order and [out[k] for k in (0, 5, 11)] == [0, 5, 11]
        assert len(ordering.crossing_pairs(p[out])) <= len(ordering.crossing_pairs(p))
        assert ordering.path_steps(ordering.step_lengths(p), out).max() <= cap + 1e-9


def test_golden_order_is_uniform():
    centers = [np.pi * (k + 0.5) / 50 for k in range(50)]
    order = ordering.golden_order(centers)
    assert sorted(order) == list(range(50))
    for n in (5, 10, 20, 35):
        angles = np.sort([centers[k] for k in order[:n]])
        gaps = np.diff(np.append(angles, angles[0] + np.pi))
        assert gaps.max() < 3 * np.pi / n


@pytest.mark.parametrize("trajectory", ["laminar", "radial"])
def test_schedule_is_a_partition(spark, trajectory):
    mask = lattice.sampling_masks(spark, "rand", 24, 16, 2, 4, seed=0, seed_per_frame=True).where("sampled").select("frame", "iy", "iz")
    plan = ordering.plan_schedule(mask, trajectory, 24, 16, 12)
    assert schedule.set_difference(plan.select("frame", "iy", "iz"), mask).count() == 0
    sizes = plan.groupBy("frame", "shot").agg(F.count("*").alias("n"), F.max("echo").alias("e")).collect()
    assert len(sizes) == 16 and all(r["n"] == 12 and r["e"] == 11 for r in sizes)
    if trajectory == "laminar":
        w = schedule.blips(plan)
        assert w.where("dy < 0").count() == 0
    else:
        at = plan.withColumn("d", (F.col("iy") - 12) ** 2 + (F.col("iz") - 8) ** 2)
        best = at.groupBy("frame", "shot").agg(F.min("d").alias("least"), F.min(F.when(F.col("echo") == 5, F.col("d"))).alias("te"))
        assert best.where("least <> te").count() == 0
    with pytest.raises(ValueError):
        ordering.plan_schedule(mask, "spiral", 24, 16, 12)
