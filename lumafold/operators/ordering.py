"""Ordering samples inside shots: iterative path heuristics on a few dozen points, one shot or frame to a task.

The numpy functions work on one path; ``order_shots`` runs them for all frames as Arrow grouped maps. A group is one frame's
mask, whose size the lattice bounds.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAIN = 1e-9


def step_lengths(points: np.ndarray, scale: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Weighted Chebyshev distances between all points."""
    return np.abs((points[:, None] - points[None]) * np.asarray(scale)).max(-1)


def path_steps(distances: np.ndarray, order: list[int]) -> np.ndarray:
    return distances[order[:-1], order[1:]]


def tree_bottleneck(distances: np.ndarray) -> float:
    """The longest edge of a minimum spanning tree: no path can have a shorter longest step."""
    n = len(distances)
    if n < 2:
        return 0.0
    near, inside, longest = distances[0].copy(), np.zeros(n, bool), 0.0
    inside[0] = True
    for _ in range(n - 1):
        k = int(np.where(inside, np.inf, near).argmin())
        longest = max(longest, float(near[k]))
        inside[k] = True
        near = np.minimum(near, distances[k])
    return longest


def nearest_tour(distances: np.ndarray, start: int = 0, end: int | None = None) -> list[int]:
    """Greedy path from ``start``; ``end``, if given, comes last."""
    n = len(distances)
    left = set(range(n)) - {start} - ({end} if end is not None and end != start else set())
    order = [start]
    while left:
        at = order[-1]
        order.append(min(left, key=lambda k: (distances[at, k], k)))
        left.remove(order[-1])
    return order + ([end] if end is not None and end != start else [])


def _reversals(d: np.ndarray, fixed_start: bool, fixed_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all reversals of places i..j of a path whose places have distances ``d``: the new link on the left, the one on the
    right (zero beyond an end), and which reversals are allowed."""
    n = len(d)
    left = np.vstack([np.zeros(n), d[:-1]])
    right = np.hstack([d[:, 1:], np.zeros((n, 1))])
    allowed = np.triu(np.ones((n, n), bool), 1)
    allowed[0, n - 1] = False
    if fixed_start:
        allowed[0] = False
    if fixed_end:
        allowed[:, n - 1] = False
    return left, right, allowed


def _reversed(order: list[int], i: int, j: int) -> list[int]:
    return order[:i] + order[i : j + 1][::-1] + order[j + 1 :]


def shorter_path(distances: np.ndarray, order: list[int], passes: int = 40, fixed_start: bool = False, fixed_end: bool = False) -> list[int]:
    """2-opt on the sum of steps, always the best reversal. Free ends may move."""
    order = list(order)
    n = len(order)
    for _ in range(passes if n > 2 else 0):
        d = distances[np.ix_(order, order)]
        left, right, allowed = _reversals(d, fixed_start, fixed_end)
        step = np.diagonal(d, 1)
        change = left + right - np.concatenate([[0.0], step])[:, None] - np.concatenate([step, [0.0]])[None]
        change[~allowed] = np.inf
        k = int(change.argmin())
        if change.flat[k] >= -GAIN:
            break
        order = _reversed(order, *divmod(k, n))
    return order


def lower_bottleneck(distances: np.ndarray, order: list[int], passes: int = 40, fixed_start: bool = False, fixed_end: bool = False) -> list[int]:
    """2-opt on the longest step (then the sum), until the spanning tree's bound is met."""
    order = list(order)
    n = len(order)
    bound = tree_bottleneck(distances)
    for _ in range(passes if n > 2 else 0):
        d = distances[np.ix_(order, order)]
        step = np.diagonal(d, 1)
        if step.max() <= bound + GAIN:
            break
        left, right, allowed = _reversals(d, fixed_start, fixed_end)
        i, j = np.indices((n, n))
        # Of the three longest steps a reversal removes two at most, so one of them or a new link is the longest.
        kept = np.zeros((n, n))
        for k in np.argsort(step, kind="stable")[-3:]:
            kept = np.where((k == i - 1) | (k == j), kept, np.maximum(kept, step[k]))
        longest = np.maximum(kept, np.maximum(left, right))
        total = step.sum() + left + right - np.concatenate([[0.0], step])[:, None] - np.concatenate([step, [0.0]])[None]
        longest[~allowed] = np.inf
        top = longest.min()
        ties = np.where(longest <= top + GAIN, total, np.inf)
        k = int(ties.argmin())
        if top > step.max() - GAIN and not (top <= step.max() + GAIN and ties.flat[k] < step.sum() - GAIN):
            break
        order = _reversed(order, *divmod(k, n))
    return order


def good_path(points: np.ndarray, scale: tuple[float, float] = (1.0, 1.0), start: int | None = None, end: int | None = None, passes: int = 40) -> list[int]:
    """Nearest neighbours, then shorter, then with a lower longest step. Without a fixed start, several starts are tried."""
    d = step_lengths(points, scale)
    starts = [start] if start is not None else [k for k in range(min(len(points), 8)) if k != end] or [0]
    tried = [shorter_path(d, nearest_tour(d, s, end), passes, start is not None, end is not None) for s in starts]
    best = min(tried, key=lambda o: (float(path_steps(d, o).sum()), o)) if len(points) > 1 else [0][: len(points)]
    return lower_bottleneck(d, best, passes, start is not None, end is not None) if len(points) > 2 else best


def _side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def segments_cross(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> bool:
    return (_side(p, q, r) > 0) != (_side(p, q, s) > 0) and (_side(r, s, p) > 0) != (_side(r, s, q) > 0)


def crossing_pairs(points: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of segments at least two apart that cross, but for the first with the last."""
    m = len(points)
    if m < 4:
        return []
    a, b = points[:-1], points[1:]

    def sides(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """For every segment p-q (rows) and point r (columns), whether r lies on its left."""
        return (q[:, None, 0] - p[:, None, 0]) * (r[None, :, 1] - p[:, None, 1]) - (q[:, None, 1] - p[:, None, 1]) * (r[None, :, 0] - p[:, None, 0]) > 0

    apart = sides(a, b, a) != sides(a, b, b)
    hit = np.triu(apart & apart.T, 2)
    hit[0, m - 2] = False
    return list(map(tuple, np.argwhere(hit).tolist()))


def _swaps(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For swaps of the places i and j, at least two apart, of a path whose places have distances ``d``: the change of its length, and
    the longest new link (zeros beyond an end)."""
    n = len(d)
    before, after = np.vstack([np.zeros(n), d[:-1]]), np.vstack([d[1:], np.zeros(n)])  # [i, k]: from the place before, or after, i to k
    own = np.diagonal(before) + np.diagonal(after)
    change = before + after + before.T + after.T - own[:, None] - own[None]
    return change, np.maximum(np.maximum(before, after), np.maximum(before, after).T)


def _swapped(order: list[int], i: int, j: int) -> list[int]:
    out = list(order)
    out[i], out[j] = out[j], out[i]
    return out


def uncrossed(points: np.ndarray, scale: tuple[float, float], order: list[int], cap: float, pinned: set[int] = frozenset(), passes: int = 40) -> list[int]:
    """Fewer crossings without a step over ``cap`` and without moving the pinned places.

    First the weighted Euclidean length goes down by reversals and by swaps of two places, whichever gains most, with no pin between.
    Then remaining crossings are undone one by one, by a reversal or by a swap of their ends, which may lie on both sides of a
    pin and needn't gain length, never returning to an order seen before. The best order met is returned: fewest crossings, then shortest.
    """
    weighted = points * np.asarray(scale)
    euclid = np.linalg.norm(weighted[:, None] - weighted[None], axis=-1)
    metric = step_lengths(points, scale)
    n = len(order)
    pins = np.cumsum([k in pinned for k in range(n)])
    free = pins[None, :] - np.concatenate([[0], pins[:-1]])[:, None] == 0  # no pin in i..j
    loose = ~np.array([k in pinned for k in range(n)], bool)
    apart = np.triu(loose[:, None] & loose[None], 2)

    def options(o: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Changes of length for every reversal and every swap, and which of them are allowed."""
        d, m = euclid[np.ix_(o, o)], metric[np.ix_(o, o)]
        left, right, allowed = _reversals(d, False, False)
        cap_left, cap_right, _ = _reversals(m, False, False)
        step = np.diagonal(d, 1)
        change = left + right - np.concatenate([[0.0], step])[:, None] - np.concatenate([step, [0.0]])[None]
        traded, _ = _swaps(d)
        return change, allowed & free & (cap_left <= cap + GAIN) & (cap_right <= cap + GAIN), traded, apart & (_swaps(m)[1] <= cap + GAIN)

    def rank(o: list[int]) -> tuple[int, float]:
        return len(crossing_pairs(points[o])), float(path_steps(euclid, o).sum())

    order = list(order)
    if n < 4:
        return order
    start = (rank(order), order)
    for _ in range(passes):
        change, allowed, traded, swappable = options(order)
        change[~allowed] = np.inf
        traded[~(swappable & free)] = np.inf
        k, t = int(change.argmin()), int(traded.argmin())
        if min(change.flat[k], traded.flat[t]) >= -GAIN:
            break
        order = _reversed(order, *divmod(k, n)) if change.flat[k] <= traded.flat[t] else _swapped(order, *divmod(t, n))
    best, seen = min(start, (rank(order), order)), {tuple(order)}
    for _ in range(passes):
        crossed = crossing_pairs(points[order])
        if not crossed:
            break
        _, allowed, _, swappable = options(order)
        trials = [_reversed(order, i + 1, j) for i, j in crossed if allowed[i + 1, j]]
        trials += [_swapped(order, a, b) for i, j in crossed for a, b in ((i, j), (i + 1, j + 1), (i, j + 1), (i + 1, j)) if swappable[a, b]]
        found = [(rank(o), o) for o in trials if tuple(o) not in seen]
        if not found:
            break
        order = min(found)[1]
        seen.add(tuple(order))
        best = min(best, min(found))
    return best[1]


def row_directions(rows: list[int], columns: list[list[int]], scale: tuple[float, float] = (1.0, 1.0), objective: str = "sum") -> list[str]:
    """For each row, forward or backward, so that the links between rows are least in sum or in maximum: exact, by two states a row."""
    if objective not in ("sum", "max"):
        raise ValueError("the objective is 'sum' or 'max'")
    join = (lambda a, b: a + b) if objective == "sum" else max

    def ends(k: int, way: str) -> tuple[int, int]:
        first, last = columns[k][0], columns[k][-1]
        return (first, last) if way == "F" else (last, first)

    cost, back = {"F": 0.0, "B": 0.0}, []
    for k in range(1, len(rows)):
        new, came = {}, {}
        for way in "FB":
            for was in "FB":
                link = max(abs(rows[k] - rows[k - 1]) * scale[0], abs(ends(k, way)[0] - ends(k - 1, was)[1]) * scale[1])
                total = join(cost[was], link)
                if way not in new or total < new[way]:
                    new[way], came[way] = total, was
        cost = new
        back.append(came)
    way = "F" if cost["F"] <= cost["B"] else "B"
    out = [way]
    for came in reversed(back):
        way = came[way]
        out.append(way)
    return out[::-1]


def row_links(rows: list[int], columns: list[list[int]], ways: list[str], scale: tuple[float, float] = (1.0, 1.0)) -> list[float]:
    """Lengths of the links from each row's end to the next row's start."""
    tail = [c[-1] if w == "F" else c[0] for c, w in zip(columns, ways, strict=True)]
    head = [c[0] if w == "F" else c[-1] for c, w in zip(columns, ways, strict=True)]
    return [max(abs(b - a) * scale[0], abs(head[k + 1] - tail[k]) * scale[1]) for k, (a, b) in enumerate(pairwise(rows))]


def best_directions(rows: list[int], columns: list[list[int]], scale: tuple[float, float] = (1.0, 1.0), passes: int = 40) -> list[str]:
    """Least sum, then single flips while the longest link gets shorter."""
    ways = row_directions(rows, columns, scale, "sum")
    for _ in range(passes):
        links = row_links(rows, columns, ways, scale)
        if not links:
            break
        options = []
        for k in range(len(ways)):
            flipped = ways[:k] + ["B" if ways[k] == "F" else "F"] + ways[k + 1 :]
            options.append((max(row_links(rows, columns, flipped, scale)), k))
        top, k = min(options)
        if top >= max(links) - GAIN:
            break
        ways[k] = "B" if ways[k] == "F" else "F"
    return ways


def golden_order(centers: list[float]) -> list[int]:
    """Wedges in golden-angle order: each shot takes the nearest unused wedge to its target angle, modulo pi."""
    left, out = list(range(len(centers))), []
    for t in range(len(centers)):
        target = math.fmod(t * math.pi * (math.sqrt(5) - 1) / 2, math.pi)
        gap = [min(abs(centers[k] - target) % math.pi, math.pi - abs(centers[k] - target) % math.pi) for k in left]
        out.append(left.pop(int(np.argmin(gap))))
    return out


def laminar_order(points: np.ndarray, scale: tuple[float, float]) -> list[int]:
    """Rows ascending, each swept forward or backward."""
    rows = sorted(set(points[:, 0].tolist()))
    columns = [sorted(points[points[:, 0] == r, 1].tolist()) for r in rows]
    ways = best_directions(rows, columns, scale)
    at = {tuple(p): k for k, p in enumerate(points.tolist())}
    return [at[(r, z)] for r, c, w in zip(rows, columns, ways, strict=True) for z in (c if w == "F" else c[::-1])]


def spoke_order(points: np.ndarray, center: tuple[float, float], scale: tuple[float, float], etl: int) -> list[int]:
    """Along the spoke through the centre, which is reached at echo (etl - 1) // 2; both halves reach from their farthest point."""
    n = len(points)
    offset = points - np.asarray(center)
    theta = np.arctan2(offset[:, 1], offset[:, 0])
    axis = 0.5 * math.atan2(np.sin(2 * theta).mean(), np.cos(2 * theta).mean())
    projection = np.round(offset @ np.array([math.cos(axis), math.sin(axis)]), 9)
    by = np.lexsort((points[:, 1], points[:, 0], projection)).tolist()
    distance = (offset**2).sum(1)
    pivot = min(by, key=lambda k: (distance[k], by.index(k)))
    others = [k for k in by if k != pivot]
    target = min((etl - 1) // 2, n - 1)

    def half(part: list[int], outward: bool) -> list[int]:
        """From the pivot's neighbourhood to the farthest point, or back."""
        if len(part) < 2:
            return part
        far = max(range(len(part)), key=lambda k: (distance[part[k]], -k))
        near = min(range(len(part)), key=lambda k: (distance[part[k]], k))
        path = good_path(points[part], scale, near if near != far else None, far)
        ordered = [part[k] for k in path]
        return ordered if outward else ordered[::-1]

    order = half(others[:target], False) + [pivot] + half(others[target:], True)
    if n > 3:
        cap = float(path_steps(step_lengths(points, scale), order).max())
        order = uncrossed(points, scale, order, cap, {0, target, n - 1})
    return order


TRAJECTORIES = ("laminar", "radial")


def order_shots(parts: DataFrame, trajectory: str, ny: int, nz: int, etl: int, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """frame, shot, echo, iy, iz from samples with a part: frame, part, iy, iz.

    laminar: parts are shots in turn. radial: parts are wedges, put in golden-angle order. A frame is one group.
    """
    if trajectory not in TRAJECTORIES:
        raise ValueError(f"unknown trajectory {trajectory!r}; known: {', '.join(TRAJECTORIES)}")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, points = table["part"].to_numpy(), np.column_stack([table["iy"].to_numpy(), table["iz"].to_numpy()])
        names = np.unique(part).tolist()
        groups = []
        for p in names:
            own = points[part == p]
            groups.append(own[np.lexsort((own[:, 1], own[:, 0]))])
        if trajectory == "radial":
            folded = [float(np.mod(np.arctan2(g[:, 1] - nz / 2, g[:, 0] - ny / 2), math.pi).mean()) for g in groups]
            groups = [groups[k] for k in golden_order(folded)]
        shots, echoes, ys, zs = [], [], [], []
        for shot, own in enumerate(groups):
            order = laminar_order(own, scale) if trajectory == "laminar" else spoke_order(own.astype(float), (ny / 2, nz / 2), scale, etl)
            shots += [shot] * len(order)
            echoes += range(len(order))
            ys += own[order, 0].astype(int).tolist()
            zs += own[order, 1].astype(int).tolist()
        return pa.table({"frame": pa.array([key[0].as_py()] * len(shots), pa.int32()), "shot": pa.array(shots, pa.int32()), "echo": pa.array(echoes, pa.int32()), "iy": pa.array(ys, pa.int32()), "iz": pa.array(zs, pa.int32())})

    return parts.select(F.col("frame").cast("int").alias("frame"), "part", "iy", "iz").groupBy("frame").applyInArrow(run, "frame int, shot int, echo int, iy int, iz int")


def plan_schedule(mask: DataFrame, trajectory: str, ny: int, nz: int, etl: int, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The schedule of a mask's sampled cells (frame, iy, iz): native partitioning, then ordering by frame."""
    from lumafold.operators import schedule as S

    if trajectory == "laminar":
        parts = S.sequential_parts(mask, ny, etl)
    elif trajectory == "radial":
        parts = S.wedge_parts(mask, ny, nz, etl).withColumnRenamed("wedge", "part")
    else:
        raise ValueError(f"unknown trajectory {trajectory!r}; known: {', '.join(TRAJECTORIES)}")
    return order_shots(parts, trajectory, ny, nz, etl, scale)
