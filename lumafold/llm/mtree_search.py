"""Exact top-k by inner product with M-trees.

Vectors of integers get one more coordinate so that all of a block have the same length, and queries get a zero there: among
vectors of one length, the largest inner product is the smallest distance, so a metric tree finds it.

* Rows are spread over blocks of near vectors: each goes to the nearest of some pivots (at most FANOUT rows of a node, which decide
  only the layout), and nodes with more than ``block_rows`` rows are split again in the same way, so blocks stay small balls
  however large the table is. Only a node of equal pivots is dealt out by hash, so a vector that fills the table fills many blocks.
* Each block is an M-tree of pages: a leaf page holds vectors with their distances to the page's routing object; an
  inner page holds routing objects with covering radii and their distances to the parent's object.
* Best-first search visits pages by the least distance that they could hold. An entry whose stored parent distance
  already rules it out by the triangle inequality is skipped without computing its own distance.
* Each block's tree is built once and written, with its block's mean and covering radius beside it. Blocks that are neighbours in
  the tree of splits form bins of about BIN times ``block_rows`` rows, with balls of their own.
* Queries travel packed, up to ``query_rows`` of one bin to a row, and only between shuffles: what Spark joins or sends around are
  names of packs and bins. A pack carries its queries' floors, the k-th scores that they reached so far, and their best rows.
* A query first searches its own block, then the other blocks of its bin that may offer its floor or more: at most the product
  with the block's mean plus the query's length times the radius. Bins are ruled out for a pack in the same way, homes (the first
  split's nodes, FANOUT + 1 at most) before the bins in them.
* Of the other bins each pack searches the FIRST that may offer most first; the floors found by then are tested against the rest.
* Inside a task, blocks of a bin are searched from the most promising on, so floors rise from block to block, and a full bin is
  copied once for each ``query_rows`` queries that it concerns. Each bin returns the rows that may still be among a query's k best.

Scores are exact: distances (floats) only prune, with slack, and every reported score is an integer product, multiplied as floats
where these hold each partial sum exactly. Where products could pass 64 bits they are taken with Python's integers; a reported score, or a scaled component, that itself doesn't fit into
64 bits is an error, since the result has no type for it.

Vectors that are null, or hold a null or non-finite component, or another number of components than most, take no part;
neither do rows without an id. Ties go to the smaller id, then repeated ids keep all rows but those with the query's own id.
A query id that occurs twice asks twice (equal rows once), and its results are ranked together.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumafold.llm.common import stage

#: Vectors of a leaf page, and entries of an inner page.
LEAF, FAN = 256, 16
#: Pivots of a split, and blocks of a page.
FANOUT = 64
#: Rows of a bin, in full blocks; blocks of a bin, in small ones.
BIN, MANY = 8, 512
#: Rows of a node that one task assigns to pivots.
ASSIGNED = 1 << 16
#: Bins that a pack searches first, beside its own, to raise its floors before the others are tested again.
FIRST = 4
#: Splits by pivots; beyond, a node is dealt out by hash (it would hold FANOUT ** DEEPEST blocks if pivots split it evenly).
DEEPEST = 8
#: Share of a distance that floating-point error may take.
SLACK = 1e-6
#: Share of the squared lengths that floating-point error may take where they cancel.
CANCEL = 1e-12


class MTree:
    """An M-tree over the rows of ``points`` (floats of one length), with pages in arrays."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.pages: list[dict] = []
        self.root = self._build(np.arange(len(points)), None) if len(points) else -1

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        """A page over ``rows``, whose routing object lies at ``parent``."""
        page: dict = {"rows": None}
        at = len(self.pages)
        self.pages.append(page)
        center = self.points[rows].mean(axis=0) if parent is None else parent
        if len(rows) <= LEAF:
            page["rows"], page["near"] = rows, np.linalg.norm(self.points[rows] - center, axis=1)
            order = np.argsort(page["near"], kind="stable")
            page["rows"], page["near"] = rows[order], page["near"][order]
        else:
            groups = self._split(rows)
            objects = np.array([self.points[g].mean(axis=0) for g in groups])
            page["objects"] = objects
            page["radius"] = np.array([np.linalg.norm(self.points[g] - o, axis=1).max() for g, o in zip(groups, objects, strict=True)])
            page["near"] = np.linalg.norm(objects - center, axis=1)
            page["children"] = [self._build(g, o) for g, o in zip(groups, objects, strict=True)]
        if parent is None:
            page["center"] = center
            page["reach"] = float(np.linalg.norm(self.points[rows] - center, axis=1).max())
        return at

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Groups of near rows, none larger than half, of about half a leaf page if FAN suffice for that: farthest-point seeds, then nearest seed."""
        x = self.points[rows]
        seeds = [0]
        gap = np.linalg.norm(x - x[0], axis=1)
        nearest = np.zeros(len(rows), int)
        while len(seeds) < min(FAN, -(-2 * len(rows) // LEAF)) and gap.max() > 0:
            seeds.append(int(gap.argmax()))
            d = np.linalg.norm(x - x[seeds[-1]], axis=1)
            closer = d < gap
            gap[closer], nearest[closer] = d[closer], len(seeds) - 1
        groups = [rows[nearest == k] for k in range(len(seeds))]
        limit = max(LEAF, len(rows) // 2)
        return [part for g in groups if len(g) for part in np.array_split(g, -(-len(g) // limit))]


def search_tree(tree: MTree, ints: np.ndarray, ids: np.ndarray, length2: float, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows (score, then smaller id) of a tree for each of many integer queries, among scores of its floor or more.

    ``ints`` and ``ids`` are the tree's rows, sorted by id. Returns row numbers and scores (queries x k; row -1 where there
    are fewer). Best-first: pages wait in a heap by the least distance at which any of their queries could still find
    something; a page carries the queries that it concerns, and each query drops out as soon as its own bound allows.
    """
    n, m = len(ints), len(queries)
    if not n or not m:
        return np.full((m, k), -1), np.zeros((m, k), np.int64)
    largest = _largest_product(ints, queries)
    empty = -largest - 2  # below every score
    kind = np.int64 if largest < 1 << 62 else object
    exact = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else kind  # holds each partial sum
    packed = (largest + 2) * n < 1 << 62
    floats = np.column_stack([queries.astype(float), np.zeros(m)])
    ints, queries = ints.astype(exact), queries.astype(exact)
    scores, places, worst = np.full((m, k), empty, kind), np.full((m, k), -1), np.full(m, empty, kind)
    need = _lowered(floors)
    q2 = (floats**2).sum(axis=1)

    def reach(q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a score lies."""
        with np.errstate(invalid="ignore"):
            square = q2[q] + length2
            return np.sqrt(np.maximum(square - 2 * score.astype(float), 0.0) + CANCEL * square) * (1 + SLACK) + SLACK

    everyone = np.arange(m)
    limit = reach(everyone, floors)
    top = tree.pages[tree.root]
    start = np.linalg.norm(floats - top["center"], axis=1)
    heap: list[tuple] = [(0.0, 0, tree.root, everyone, start, np.maximum(start - top["reach"], 0.0))]
    pushed = 0
    while heap:
        _, _, at, who, own, least = heapq.heappop(heap)
        still = least <= limit[who]
        if not still.any():
            continue
        who, own = who[still], own[still]
        page = tree.pages[at]
        # |d(query, parent) - d(entry, parent)| bounds the distance from below, without computing it.
        if page["rows"] is not None:
            some = (page["near"] >= (own - limit[who]).min()) & (page["near"] <= (own + limit[who]).max())
            if not some.any():
                continue
            rows = page["rows"][some]
            found = queries[who] @ ints[rows].T
            hit = found >= need[who].astype(np.float32 if exact is np.float32 else np.float64)[:, None]
            better = hit.any(axis=1)
            if not better.any():
                continue
            who, found = who[better], found[better].astype(kind)
            found[~hit[better] | (ids[rows][None] == query_ids[who][:, None])] = empty
            score, place = np.concatenate([scores[who], found], axis=1), np.concatenate([places[who], np.broadcast_to(rows, found.shape)], axis=1)
            # Without overflow, one number can stand for score and place; larger is better, ties to the smaller place.
            best = np.argpartition(score * n + (n - 1 - place), score.shape[1] - k, axis=1)[:, -k:] if packed else _best(score, place, k)
            scores[who], places[who] = np.take_along_axis(score, best, axis=1), np.take_along_axis(place, best, axis=1)
            worst[who] = scores[who].min(axis=1)
            full = who[worst[who] > empty]
            limit[full] = np.minimum(limit[full], reach(full, np.maximum(worst[full].astype(float), floors[full])))
            need[full] = np.maximum(need[full], _lowered(worst[full].astype(float)))
            continue
        maybe = np.abs(own[:, None] - page["near"][None]) - page["radius"][None] <= limit[who][:, None]
        for e in np.flatnonzero(maybe.any(axis=0)).tolist():
            asked = who[maybe[:, e]]
            d = np.linalg.norm(floats[asked] - page["objects"][e], axis=1)
            low = np.maximum(d - page["radius"][e], 0.0)
            near = low <= limit[asked]
            if near.any():
                pushed += 1
                heapq.heappush(heap, (float(low[near].min()), pushed, page["children"][e], asked[near], d[near], low[near]))
    best = _best(scores, places, k)
    scores, places = np.take_along_axis(scores, best, axis=1), np.take_along_axis(places, best, axis=1)
    return np.where(scores == empty, -1, places), scores


def _lowered(floors: np.ndarray) -> np.ndarray:
    """Floors without what rounding to doubles may have added."""
    return floors - CANCEL * np.abs(np.where(np.isfinite(floors), floors, 0.0))


def _largest_product(x: np.ndarray, y: np.ndarray) -> int:
    """A bound of the absolute products of rows of ``x`` and ``y``."""
    largest = [max(int(v.max()), -int(v.min())) if v.size else 0 for v in (x, y)]
    return x.shape[1] * largest[0] * largest[1]


def _best(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: by score, then by the smaller place."""
    by_place = np.argsort(place, axis=1, kind="stable")
    by_score = np.argsort(-np.take_along_axis(score, by_place, axis=1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(by_place, by_score, axis=1)


def _squares(ints: np.ndarray) -> np.ndarray:
    """The exact squared length of each row."""
    return (ints.astype(np.int64 if _largest_product(ints, ints) < 1 << 62 else object) ** 2).sum(axis=1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the narrowest integers that hold it."""
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(t).max))


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """id and v (array<long>): floor(scale * x) of usable vectors."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = lambda c: F.abs(c * scale) < 2.0**63
    whole = lambda c: F.when(fits(c), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a scaled component doesn't fit into 64 bits")).cast("long"))
    return table.where(usable).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _array(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def near_blocks(vectors: DataFrame, block_rows: int, max_pivots: int = FANOUT) -> DataFrame:
    """vectors (id, v) with block (a path of splits), page (at most FANOUT blocks that were split from one node) and home (its first split).

    A level of splits is one shuffle of the rows whose node is still too large. The number of levels is that of a tree of FANOUT
    over the blocks, DEEPEST at most.
    """
    spark = vectors.sparkSession
    rows, settled = vectors.withColumn("block", F.lit("")), []
    key = F.xxhash64("id", "v")

    def assign(group: tuple, own: pa.Table, pivots: pa.Table) -> pa.Table:
        if not own.num_rows:
            return own.select(["id", "v", "block"])
        at, x = group[0].as_py(), _array(own["v"].combine_chunks()).astype(np.float64)
        p = np.array(pivots["pivots"][0].as_py(), dtype=np.float64)
        nearest = ((p**2).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
        return pa.table({"id": own["id"], "v": own["v"], "block": pa.array([f"{at}{k}/" for k in nearest.tolist()], pa.string())})

    for level in range(DEEPEST + 1):
        sizes = rows.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
        large = F.broadcast(stage(sizes, "large-nodes"))  # at most a row for each block_rows rows
        if not large.count():
            break
        settled.append(rows.join(large, "block", "left_anti"))
        inside = rows.join(large, "block")
        if level == DEEPEST:
            distinct = large.select("block", F.array().cast("array<array<bigint>>").alias("pivots"))
        else:
            few = F.least(F.lit(max_pivots), F.ceil(2 * F.col("n") / block_rows))
            # Spark keeps the first rows of each partition before it shuffles, so no task sees all rows of a node.
            drawn = inside.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(key, "id"))).where(F.col("rank") <= max_pivots).where(F.col("rank") <= few)
            distinct = drawn.groupBy("block").agg(F.array_sort(F.collect_set("v")).alias("pivots"))
        found = stage(distinct.join(large, "block").select("block", "n", "pivots"), "pivots")
        equal = found.where(F.size("pivots") < 2).select("block", F.ceil(F.col("n") / block_rows).alias("parts"))
        settled.append(rows.join(F.broadcast(equal), "block").select("id", "v", F.concat("block", F.lit("x"), F.pmod(key, F.col("parts")).cast("string"), F.lit("/")).alias("block")))
        split = found.where(F.size("pivots") >= 2).select("block", "pivots", F.ceil(F.col("n") / ASSIGNED).cast("int").alias("parts"))
        dealt = rows.join(F.broadcast(split.select("block", "parts")), "block").withColumn("part", F.pmod(key, F.col("parts")).cast("int")).select("id", "v", "block", "part")
        shown = split.select("block", "pivots", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        rows = stage(dealt.groupBy("block", "part").cogroup(shown.groupBy("block", "part")).applyInArrow(assign, "id long, v array<long>, block string"), "split")
    for more in settled:
        rows = rows.unionByName(more.select("id", "v", "block"))
    number = F.regexp_extract("block", r"x(\d+)/$", 1)
    page = F.regexp_replace("block", r"x?\d+/$", "")
    page = F.when(number != "", F.concat(page, F.lit("x"), F.floor(number.try_cast("long") / FANOUT).cast("string"))).otherwise(page)
    home = F.regexp_extract("block", r"^(x|\d+/)?", 1)
    return stage(rows.select("id", "v", "block", page.alias("page"), home.alias("home")), "blocks")


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = 4096, query_rows: int = 1024, max_pivots: int = FANOUT, counts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``table`` (vec_id, embedding) for each row that ``is_query`` selects.

    ``max_pivots`` (FANOUT at most) bounds the pivots of one split. ``counts``, if given, gets the number of blocks, and of pairs of a
    query and another block: possible ones, those of bins that pass for the query, and those kept, which are searched.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, scale)
    common = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = common["n"]
    placed = near_blocks(stage(vectors.where(F.size("v") == dim), "vectors"), block_rows, min(max_pivots, FANOUT))
    where = stage(_bins(placed, block_rows), "bins").hint("merge")
    trees = stage(placed.join(where, "block").groupBy("block").applyInArrow(_plant, TREES), "trees")
    queries = placed.where(is_query).select("id", "v", "block").distinct().join(where, "block")
    parts = F.ceil(F.count("*").over(Window.partitionBy("bin")) / query_rows)
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("id", "v"), parts).cast("int"))
    packs = stage(dealt.groupBy("bin", "part").applyInArrow(_pack, PACKS), "queries")
    # Phase 1: a query's k-th score in its own bin bounds what any other bin must reach.
    found = stage(_dealt(trees, packs, packs.select("pack", "bin", "n"), block_rows, query_rows, k, True), "own-bins")
    packs, tried = stage(_merged(packs, found, k), "reached"), [found]
    balls = stage(trees.groupBy("bin").applyInArrow(_cover, BALLS), "balls")
    # Phase 2: the bins that may hold more, first by home (at most FANOUT + 1 balls), and of these the most promising ones.
    near = _may_reach(packs, _homes(balls)).hint("merge").join(balls, "home").where(F.col("bin") != F.col("own_bin"))
    near = _still_reached(packs, near).withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("offer"), "bin")))
    near = stage(near, "near-bins")
    found = stage(_dealt(trees, packs, near.where(F.col("place") <= FIRST), block_rows, query_rows, k), "first-bins")
    packs, tried = stage(_merged(packs, found, k), "raised"), [*tried, found]
    # Phase 3: what may still reach the floors by now.
    left = near.where(F.col("place") > FIRST).select("pack", "bin").hint("merge").join(balls, "bin")
    left = stage(_still_reached(packs, left), "left-bins")
    found = stage(_dealt(trees, packs, left, block_rows, query_rows, k), "left-found")
    packs, tried = stage(_merged(packs, found, k), "found"), [*tried, found]
    if counts is not None:
        total = lambda frame, x: frame.agg(F.coalesce(F.sum(x), F.lit(0))).first()[0]
        count, own = trees.count(), packs.join(balls, "bin")
        counts |= {"blocks": count, "possible": total(packs, "n") * (count - 1), "reached": total(near, "pairs") + total(own, F.col("n") * (F.col("blocks") - 1)), "kept": sum(total(x, "tried") for x in tried)}
    return _ranked(packs.select("ids", "who", "vec_id", "score").mapInArrow(_rows, "query_id long, vec_id long, score long"), k)


def _bins(placed: DataFrame, block_rows: int) -> DataFrame:
    """block, bin and at (the block's place in its bin): neighbouring blocks of a home share a bin, up to about BIN * block_rows rows."""
    sizes = placed.groupBy("home", "block").agg(F.greatest(F.count("*"), F.lit(BIN * block_rows // MANY)).alias("rows"))  # a row for each block
    by_home = Window.partitionBy("home").orderBy("block")
    before = F.sum("rows").over(by_home.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    numbered = sizes.withColumn("bin", F.concat("home", F.lit("b"), F.floor(before / (BIN * block_rows)).cast("string")))
    return numbered.select("block", "bin", F.row_number().over(Window.partitionBy("bin").orderBy("block")).alias("at"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    # Spark keeps the k best of each partition before it shuffles, so no task sees all blocks' rows of a query.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: A written block: its tree, and a ball (mean and radius, as bytes of doubles) that covers it.
TREES = "block string, home string, bin string, at int, rows int, center binary, radius double, tree binary"
#: Queries of a bin, packed: ids, vectors (narrow integers of type ``kind``), places of their blocks in the bin, floors, and the best
#: rows so far (the query's place in the pack, the row's id, the score), as bytes of numbers.
PACKS = "pack string, bin string, home string, n int, kind string, ids binary, v binary, own binary, floors binary, who binary, vec_id binary, score binary"
#: What a pack found in a bin, and how many pairs of a query and a block that isn't its own were searched.
FOUND = "pack string, who binary, vec_id binary, score binary, tried long"
#: A ball that covers a bin of so many blocks.
BALLS = "home string, bin string, blocks int, center binary, radius double"


def _plant(key: tuple, vectors: pa.Table) -> pa.Table:
    """The M-tree of a block's vectors, brought to the length of the longest of the block, so that an outlier dulls its own block only."""
    vectors = vectors.sort_by("id")
    ids, ints = vectors["id"].to_numpy(), _array(vectors["v"].combine_chunks()).astype(np.int64)
    squares = _squares(ints)
    length2, spare = float(squares.max()), np.sqrt((squares.max() - squares).astype(float))
    tree = MTree(np.column_stack([ints.astype(float), spare]))
    tree.points = np.empty((0, 0))  # the search takes vectors from ``ints``
    floats = ints.astype(float)
    center = floats.mean(axis=0)
    radius = float(np.linalg.norm(floats - center, axis=1).max()) * (1 + SLACK)
    one = vectors.slice(0, 1)
    return pa.table({"block": pa.array([key[0].as_py()], pa.string()), "home": one["home"], "bin": one["bin"], "at": one["at"], "rows": pa.array([len(ids)], pa.int32()), "center": pa.array([center.tobytes()], pa.binary()), "radius": [radius], "tree": pa.array([pickle.dumps((tree, ids, _narrow(ints), length2))], pa.binary())})


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    name, part, n = key[0].as_py(), key[1].as_py(), rows.num_rows
    v, nothing = _narrow(_array(rows["v"].combine_chunks())), np.empty(0, np.int64)
    arrays = {"ids": rows["id"].to_numpy(), "v": v, "own": rows["at"].to_numpy(), "floors": np.full(n, -np.inf), "who": nothing, "vec_id": nothing, "score": nothing}
    return pa.table({"pack": [f"{name}p{part}"], "bin": [name], "home": [name.rpartition("b")[0]], "n": pa.array([n], pa.int32()), "kind": [v.dtype.str]} | {x: pa.array([y.tobytes()], pa.binary()) for x, y in arrays.items()})


def _vectors(pack: dict) -> np.ndarray:
    return np.frombuffer(pack["v"], pack["kind"]).reshape(pack["n"], -1)


def _cover(key: tuple, trees: pa.Table) -> pa.Table:
    """The ball of a bin: around the mean of its blocks' centres (MANY at most, or a few more)."""
    centers = np.array([np.frombuffer(x) for x in trees["center"].to_pylist()])
    center = centers.mean(axis=0)
    radius = float((np.linalg.norm(centers - center, axis=1) + trees["radius"].to_numpy()).max()) * (1 + SLACK)
    return pa.table({"home": trees["home"].slice(0, 1), "bin": pa.array([key[0].as_py()], pa.string()), "blocks": pa.array([len(centers)], pa.int32()), "center": pa.array([center.tobytes()], pa.binary()), "radius": [radius]})


def _homes(balls: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, centres and radii of balls that cover all bins of each home (FANOUT + 1 at most)."""

    def widest(key: tuple, table: pa.Table) -> pa.Table:
        center = np.frombuffer(table["middle"][0].as_py())
        centers = np.array([np.frombuffer(x) for x in table["center"].to_pylist()])
        radius = float((np.linalg.norm(centers - center, axis=1) + table["radius"].to_numpy()).max()) * (1 + SLACK)
        return pa.table({"home": table["home"].slice(0, 1), "radius": [radius]})

    # Any centre will do: the first bin's, so that radii are maxima over parts of a home.
    middle = balls.groupBy("home").agg(F.min_by("center", "bin").alias("middle"))
    split = balls.select("home", "center", "radius", F.pmod(F.xxhash64("bin"), F.lit(64)).alias("part")).join(middle, "home")
    radii = split.groupBy("home", "part").applyInArrow(widest, "home string, radius double").groupBy("home").agg(F.max("radius").alias("radius"))
    rows = middle.join(radii, "home").toArrow()
    return rows["home"].to_pylist(), np.array([np.frombuffer(x) for x in rows["middle"].to_pylist()]), rows["radius"].to_numpy()


def _offers(v: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """At least the largest product that each query (a row of ``v``) could have with a point of each ball."""
    inner, length = v @ centers.T, np.linalg.norm(v, axis=1)[:, None]
    size = length * (np.linalg.norm(centers, axis=1) + radii)[None]
    return inner + length * radii[None] + SLACK * size + SLACK


def _may_reach(packs: DataFrame, homes: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """pack, own_bin and home, for each home that may offer some query of the pack its floor or more."""
    names, centers, radii = homes

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pack = batch.slice(row, 1).to_pylist()[0]
                some = np.flatnonzero((_offers(_vectors(pack).astype(float), centers, radii) >= np.frombuffer(pack["floors"])[:, None]).any(axis=0)).tolist()
                yield pa.RecordBatch.from_pydict({"pack": pa.array([pack["pack"]] * len(some), pa.string()), "own_bin": pa.array([pack["bin"]] * len(some), pa.string()), "home": pa.array([names[b] for b in some], pa.string())})

    return packs.select("pack", "bin", "n", "kind", "v", "floors").mapInArrow(prune, "pack string, own_bin string, home string")


def _still_reached(packs: DataFrame, near: DataFrame) -> DataFrame:
    """pack, bin, n, offer and pairs of ``near`` (pack and a bin's ball), where the bin may offer some query of the pack its floor or more.

    n: queries of the pack; offer: the most that the bin may hold beyond a floor of these, or at all while one has none; pairs: of
    these queries that the bin may offer something, and its blocks.
    """

    def test(key: tuple, packed: pa.Table, balls: pa.Table) -> pa.Table:
        kept, most, pairs, n = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), 0
        if packed.num_rows and balls.num_rows:
            pack = packed.to_pylist()[0]
            n, floors = pack["n"], np.frombuffer(pack["floors"])[:, None]
            offers = _offers(_vectors(pack).astype(float), np.array([np.frombuffer(x) for x in balls["center"].to_pylist()]), balls["radius"].to_numpy())
            passing = (offers >= floors).sum(axis=0)
            kept = np.flatnonzero(passing)
            most, pairs = (offers - np.where(np.isfinite(floors), floors, 0.0)).max(axis=0)[kept], (passing * balls["blocks"].to_numpy())[kept]
        return pa.table({"pack": pa.array([key[0].as_py()] * len(kept), pa.string()), "bin": balls["bin"].take(pa.array(kept, pa.int64())), "n": pa.array([n] * len(kept), pa.int32()), "offer": pa.array(most, pa.float64()), "pairs": pa.array(pairs, pa.int64())})

    vectors = packs.select("pack", "n", "kind", "v", "floors")
    balls = near.select("pack", "bin", "blocks", "center", "radius")
    return vectors.groupBy("pack").cogroup(balls.groupBy("pack")).applyInArrow(test, "pack string, bin string, n int, offer double, pairs long")


def _dealt(trees: DataFrame, packs: DataFrame, near: DataFrame, block_rows: int, query_rows: int, k: int, own: bool = False) -> DataFrame:
    """What packs find in bins (FOUND), for pairs of these (pack, bin, n): a full bin is copied once for each ``query_rows`` of its queries.

    Smaller bins meet up to BIN times as many in a task. ``own``: the bins are those of the packs' own queries.
    """
    full = F.greatest(F.least(F.sum("rows") / (BIN * block_rows), F.lit(1.0)), F.lit(1 / BIN))
    parts = near.groupBy("bin").agg(F.sum("n").alias("n")).join(trees.groupBy("bin").agg(full.alias("full")), "bin")  # a row for each bin
    parts = F.broadcast(stage(parts.select("bin", F.ceil(F.col("n") * F.col("full") / query_rows).cast("int").alias("parts")), "parts"))
    asked = near.select("pack", "bin").join(parts, "bin").hint("merge").join(packs.drop("bin"), "pack")
    asked = asked.select("pack", "bin", "n", "kind", "ids", "v", "own", "floors", F.pmod(F.xxhash64("pack"), F.col("parts")).cast("int").alias("part"))
    dealt = trees.join(parts, "bin").select("bin", "at", "center", "radius", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def search(key: tuple, planted: pa.Table, packed: pa.Table) -> pa.Table:
        asked = packed.to_pylist() if planted.num_rows else []
        names, whos, ids, scores, tried = [], [], [], [], []
        if asked:
            for pack, *found in _search(planted, asked, k, own):
                for to, x in zip((names, whos, ids, scores, tried), (pack, *found), strict=True):
                    to.append(x if isinstance(x, str | int) else x.tobytes())
        return pa.table({"pack": pa.array(names, pa.string()), "who": pa.array(whos, pa.binary()), "vec_id": pa.array(ids, pa.binary()), "score": pa.array(scores, pa.binary()), "tried": pa.array(tried, pa.int64())})

    return dealt.groupBy("bin", "part").cogroup(asked.groupBy("bin", "part")).applyInArrow(search, FOUND)


def _search(planted: pa.Table, packs: list[dict], k: int, own: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each pack its name, and of the bin's rows the k best of each query among scores of its floor or more: the query's place, ids, scores; and the pairs searched."""
    at = planted["at"].to_numpy()
    blocks = [pickle.loads(x) for x in planted["tree"].to_pylist()]  # written by this operator
    ids, v = (np.concatenate(x) for x in zip(*((np.frombuffer(p["ids"], np.int64), _vectors(p).astype(np.int64)) for p in packs), strict=True))
    home, need = np.concatenate([np.frombuffer(p["own"], np.int32) for p in packs]), np.concatenate([np.frombuffer(p["floors"]) for p in packs])
    home = home if own else np.full(len(home), -1)
    best, tried = (np.empty(0, np.int64),) * 3, np.zeros(len(ids), np.int64)

    def look(block: int, which: np.ndarray) -> None:
        nonlocal best
        if not len(which):
            return
        tree, row_ids, ints, length2 = blocks[block]
        rows, scores = search_tree(tree, ints, row_ids, length2, v[which], ids[which], need[which], k)
        real = rows >= 0
        more = np.repeat(which, real.sum(axis=1)), row_ids[rows[real]], scores[real].astype(np.int64)
        *best, rank = _best_of(*(np.concatenate(x) for x in zip(best, more, strict=True)), k)
        last = rank == k - 1
        need[best[0][last]] = np.maximum(need[best[0][last]], best[2][last])

    for block in range(len(at)) if own else ():
        look(block, np.flatnonzero(home == at[block]))
    offers = _offers(v.astype(float), np.array([np.frombuffer(x) for x in planted["center"].to_pylist()]), planted["radius"].to_numpy())
    for block in np.argsort(-offers.max(axis=0), kind="stable").tolist():
        which = np.flatnonzero((home != at[block]) & (offers[:, block] >= need))
        tried[which] += 1
        look(block, which)
    start = 0
    for pack in packs:
        a, b = np.searchsorted(best[0], (start, start + pack["n"]))
        yield pack["pack"], best[0][a:b] - start, best[1][a:b], best[2][a:b], int(tried[start : start + pack["n"]].sum())
        start += pack["n"]


def _best_of(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score, then by the smaller id, in the order of the queries; and their ranks from 0."""
    order = np.lexsort((ids, ~scores, who))
    who = who[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    kept = rank < k
    return who[kept], ids[order][kept], scores[order][kept], rank[kept]


def _merged(packs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``packs`` with what they found (FOUND) among their best rows, and with their floors raised."""

    def merge(key: tuple, packed: pa.Table, found: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return packed
        columns = [np.concatenate([np.frombuffer(x, np.int64) for x in [packed[name][0].as_py(), *found[name].to_pylist()]]) for name in ("who", "vec_id", "score")]
        *best, rank = _best_of(*columns, k)
        floors, last = np.frombuffer(packed["floors"][0].as_py()).copy(), rank == k - 1
        floors[best[0][last]] = best[2][last]
        changed = dict(zip(("floors", "who", "vec_id", "score"), (floors, *best), strict=True))
        return pa.table({x: pa.array([changed[x].tobytes()], pa.binary()) if x in changed else packed[x] for x in packed.schema.names})

    return packs.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(merge, PACKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best rows of packs (ids, who, vec_id, score)."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, who, found, scores = (np.frombuffer(column[row].as_py(), np.int64) for column in batch.columns)
            yield pa.RecordBatch.from_pydict({"query_id": ids[who], "vec_id": found, "score": scores})


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
