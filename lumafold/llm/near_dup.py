"""MinHash near-duplicates with sequential Bayesian verification.

Texts are sets of distinct ``width``-word shingles (A-Z lower-cased). Two sets are linked if
``100 * intersection >= percent * union``; documents reachable over links form a component.

1. Equal sets (by 128 bits over their shingle hashes) are one node, so copies cost nothing beyond their own row.
2. A node's MinHash signature is cut into bands of ROWS values; equal bands make a bucket.
3. In each bucket every node is paired with one pivot only. A pair's signatures are compared batch by batch;
   it is pruned as soon as the posterior probability that its similarity reaches the threshold falls below
   ``miss`` (uniform prior, one binomial trial for each compared value).
4. Survivors are verified on their full sets of 64-bit shingle hashes: first the likeliest pair of each node,
   and then only pairs whose ends are still in different components.
5. Buckets that still hold several components are compared across them in bounded blocks: by the same batches and
   bounds, then on the full sets, each pair in the first bucket that it shares. A block only sends the links
   that join two components. A large component has blocks of its own, which never meet each other; the blocks of two
   large ones meet only if the distance of their representatives, less both radii, leaves room for a link (1 less the
   Jaccard similarity is a metric, so this bound is exact); members of small components share blocks. So a group of
   copies costs a star, no pair of a bucket is left out, and a large component costs a row a member for each
   other component that may lie near it, and for each block of small ones.
6. Where a bucket would need more than some blocks for each of its blocks (thousands of light variants of one page, say), blocks
   would meet in their square. The members of such buckets are compared over shared rare shingles instead: with shingles in
   the order of their document counts, two sets can only be linked if the first few of the smaller one and the
   first few of the other have a shingle in common (the prefix filter of set joins; exact). So variants that differ in
   shingles of their own never meet, and rows grow with members times the length of such a prefix.

A pair at the threshold 0.85 shares no band with probability (1 - 0.85^7)^36, below 1e-6.

Null texts and texts without words have no shingles and no links. Texts with fewer words than ``width`` have
their whole sequence as one shingle. Repeated rows are copies. A row without doc_id links nothing and is its
own component (null). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumafold.llm.common import drop_staged, mix64, own_memory, release, rolling, stage, text_key, word_hashes
from lumafold.llm.components import connected_components

ROWS, BANDS = 7, 36
VALUES = ROWS * BANDS
#: Signature values compared before each look at the posterior.
BATCH = 36
#: Members of one block in step 5, and bytes of their sets.
BLOCK = 2048
BLOCK_BYTES = 32 << 20

_rng = np.random.default_rng(20240229)
_FACTORS = (_rng.integers(0, 1 << 31, VALUES, np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, VALUES, np.uint32)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    found = rolling(word_hashes.of(words), min(width, len(words)))
    return np.unique(found if len(words) >= width else found + np.uint64(len(words)))


def content_id(found: np.ndarray) -> tuple[int, int]:
    """128 bits over a set, as two longs."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist()
    return a, b


def signature(found: np.ndarray) -> np.ndarray:
    """VALUES minima over the set, each under its own multiplicative hash of 32 bits."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = low[None, at : at + 2048] * _FACTORS[:, None]
        part += _SHIFTS[:, None]
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different for equal values in different bands."""
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For each number of compared values, the fewest matches at which the posterior P(similarity >= threshold) is ``miss`` or more."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(BATCH, VALUES + 1, BATCH):
        for m in range(n + 1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() / density.sum() >= miss:
                out[n] = m
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, bounds: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the signature matrices that no batch prunes, and their matches."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for n, least in bounds.items():
        matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    return alive, matches[alive]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("words", word_hashes.clear)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, content, bands, values = [], ([], []), [], []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    found = shingles(text, width)
                    n.append(len(found))
                    if len(found):
                        sig = signature(found)
                        for x, half in zip(content, content_id(found), strict=True):
                            x.append(half)
                        bands.append(band_keys(sig).tobytes())
                        values.append((sig & np.uint32(0xFFFF)).astype("<u2").tobytes())
                    else:
                        for x in (*content, bands, values):
                            x.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in content), pa.array(bands, pa.binary()), pa.array(values, pa.binary())], ["doc", "key", "n", "h1", "h2", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), text_key().alias("key")).mapInArrow(sketch, "doc long, key long, n long, h1 long, h2 long, bands binary, sig binary")
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "sketches")


def _explode_bands(nodes: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "c"])

    return nodes.select("c", "bands").mapInArrow(explode, "key long, c long")


def _prune(pairs: DataFrame, nodes: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """a, b, m: the pairs whose signatures no batch rules out, with their matches."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive, m = surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), bounds)
                kept = batch.take(pa.array(alive))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(m)], ["a", "b", "m"])

    sig = nodes.select("c", "sig")
    joined = pairs.join(sig.withColumnsRenamed({"c": "b", "sig": "sig_b"}), "b").join(sig.withColumnsRenamed({"c": "a", "sig": "sig_a"}), "a")
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a long, b long, m int")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """c, full: the shingle hashes of wanted nodes (c, and doc and key of a row that has the set), made anew from the texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("words", word_hashes.clear)
        seen: set[int] = set()  # rows that repeat both id and text meet in one task (or, where that is split, give a set twice, which changes no link)
        for batch in batches:
            ids, sets = [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if c not in seen:
                    seen.add(c)
                    ids.append(c)
                    sets.append(shingles(text, width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["c", "full"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return stage(texts.join(wanted.hint("shuffle_hash"), ["doc", "key"]).select("c", "text").mapInArrow(make, "c long, full binary"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(j)[k].as_py(), np.uint64) for j in (2, 3))
                if similar(x, y, percent):
                    good.append(k)
            kept = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    joined = pairs.select("a", "b").join(sets.withColumnsRenamed({"c": "b", "full": "full_b"}), "b").join(sets.withColumnsRenamed({"c": "a", "full": "full_a"}), "a")
    return joined.select("a", "b", "full_a", "full_b").mapInArrow(exact, "a long, b long")


def _rooted(frame: DataFrame, roots: DataFrame | None, column: str, out: str) -> DataFrame:
    if roots is None:
        return frame.withColumn(out, F.col(column))
    named = roots.withColumnsRenamed({"node": column, "root": out + "_"})
    return frame.join(named, column, "left").withColumn(out, F.coalesce(out + "_", column)).drop(out + "_")


class _Links:
    """Verified links and the components that they make so far."""

    def __init__(self, sets: DataFrame, percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.edges: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def join(self, good: DataFrame) -> None:
        """Take in verified links (a written table)."""
        if good.limit(1).count():
            self.edges.append(good)
            every = self.edges[0]
            for more in self.edges[1:]:
                every = every.unionByName(more)
            self.roots = connected_components(every)

    def add(self, survivors: DataFrame) -> None:
        """Verify pairs (a, b, m) until no unverified one joins two components."""
        rest = survivors
        for k in range(3):
            # The likeliest pair of each node, twice; then all that still join two components.
            best = rest.groupBy("b").agg(F.max(F.struct("m", "a")).alias("x")).select(F.col("x.a").alias("a"), "b") if k < 2 else rest.select("a", "b")
            self.join(stage(_verify(best, self.sets, self.percent), f"links-{k}"))
            if k < 2:
                left = rest.join(best, ["a", "b"], "left_anti")
                rest = stage(_rooted(_rooted(left, self.roots, "a", "ra"), self.roots, "b", "rb").where("ra <> rb").select("a", "b", "m"), f"open-{k}")
                if not rest.limit(1).count():
                    break


class _Forest:
    """Union-find over component numbers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def compare_block(c: np.ndarray, root: np.ndarray, sig: np.ndarray, bands: np.ndarray, full: list[np.ndarray], left: np.ndarray, right: np.ndarray, key: int, bounds: dict[int, int], percent: int) -> list[tuple[int, int]]:
    """Links between members of ``left`` and ``right`` (row numbers) of the bucket ``key`` that join two components."""
    forest, out = _Forest(), []
    band = int(np.flatnonzero(bands[0] == key)[0])
    for k in left.tolist():
        other = right[root[right] != root[k]]
        if right is left:
            other = other[other > k]
        if band and len(other):
            other = other[~(bands[other, :band] == bands[k, :band]).any(axis=1)]
        if not len(other):
            continue
        alive, m = surviving(np.broadcast_to(sig[k], (len(other), VALUES)), sig[other], bounds)
        for x in other[alive][np.argsort(-m, kind="stable")].tolist():
            mine, its = forest.find(int(root[k])), forest.find(int(root[x]))
            if mine != its and similar(full[k], full[x], percent):
                forest.up[its] = mine
                out.append((min(int(c[k]), int(c[x])), max(int(c[k]), int(c[x]))))
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold; sizes that rule it out are not compared."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    common = int((large[place] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def distance(x: np.ndarray, y: np.ndarray) -> float:
    """1 less the Jaccard similarity of two sorted sets: a metric."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    common = int((large[place] == small).sum())
    return 1 - common / max(1, len(x) + len(y) - common)


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, d: the exact distances of pairs (a, b) of nodes."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [distance(*(np.frombuffer(batch.column(j)[k].as_py(), np.uint64) for j in (2, 3))) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], ["a", "b", "d"])

    joined = pairs.join(sets.withColumnsRenamed({"c": "b", "full": "full_b"}), "b").join(sets.withColumnsRenamed({"c": "a", "full": "full_a"}), "a")
    return joined.select("a", "b", "full_a", "full_b").mapInArrow(measure, "a long, b long, d double")


#: The cell of a bucket that holds the members of all its small components.
SMALL = -1


def cells_of(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The components of each bucket (key, root, n, bytes, rep, large), and its cells (key, g, blocks, rep); both written."""
    sized = members.join(sets.select("c", F.octet_length("full").alias("bytes")), "c")
    is_large = (F.col("n") >= block // 2) | (F.col("bytes") >= BLOCK_BYTES // 2)
    groups = stage(sized.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("c").alias("rep")).withColumn("large", is_large), "groups")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    large = groups.where("large").select("key", F.col("root").alias("g"), blocks, "rep")
    small = groups.where("not large").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("key", F.lit(SMALL).cast("long").alias("g"), blocks, F.lit(None).cast("long").alias("rep"))
    return groups, stage(large.unionByName(small), "cells")


#: Meetings of blocks, for each block of a bucket, from which its members are compared over rare shingles instead.
MEETINGS = 4


def wide_keys(cells: DataFrame) -> DataFrame:
    """key: the buckets whose blocks would meet more often than in proportion to their number."""
    n = F.col("blocks").cast("double")
    inside = F.sum(F.when(F.col("g") == SMALL, n * (n + 1) / 2).otherwise(0))
    counted = cells.groupBy("key").agg(F.sum(n).alias("n"), ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2 + inside).alias("met"))
    return counted.where(F.col("met") > MEETINGS * (F.col("n") + 1)).select("key")


def block_pairs(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, known: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """How buckets are compared: the members with cell and block, and the pairs of blocks (key, g, i, g2, i2) that have to meet.

    A cell is a large component (its root) of a bucket, or SMALL. Blocks of one large component never meet. ``known``: what
    cells_of gives for these members (it may hold other buckets too).
    """
    groups, cells = known or cells_of(members, sets, block)
    placed = members.join(groups.select("key", "root", F.when(F.col("large"), F.col("root")).otherwise(SMALL).alias("g")), ["key", "root"])
    placed = placed.join(cells.select("key", "g", "blocks"), ["key", "g"]).select("key", "c", "root", "g", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("i"))
    other = cells.select("key", F.col("g").alias("g2"), F.col("blocks").alias("blocks2"), F.col("rep").alias("rep2"))
    met = cells.join(other, "key").where(f"g < g2 or (g = {SMALL} and g2 = {SMALL})")
    both = stage(met.where("rep is not null and rep2 is not null"), "large-cells")
    if both.limit(1).count():
        tops = both.select("key", F.col("g").alias("root"), "rep").unionByName(both.select("key", F.col("g2").alias("root"), F.col("rep2").alias("rep"))).distinct()
        spokes = members.join(tops, ["key", "root"]).select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct()
        reach = stage(_distances(spokes, sets), "reach")
        radius = members.join(tops, ["key", "root"]).join(reach.withColumnsRenamed({"a": "rep", "b": "c"}), ["rep", "c"]).groupBy("key", F.col("root").alias("g")).agg(F.max("d").alias("r"))
        apart = _distances(both.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct(), sets)
        far = both.join(apart.withColumnsRenamed({"a": "rep", "b": "rep2", "d": "apart"}), ["rep", "rep2"]).join(radius, ["key", "g"]).join(radius.withColumnsRenamed({"g": "g2", "r": "r2"}), ["key", "g2"])
        far = stage(far.where(F.col("apart") > F.col("r") + F.col("r2") + (1 - percent / 100) + 1e-9).select("key", "g", "g2"), "far-cells")
        met = met.join(far, ["key", "g", "g2"], "left_anti")
    pairs = met.select("key", "g", "g2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "blocks2").select("key", "g", "g2", "i", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("i2"))
    return placed, pairs.where("g <> g2 or i <= i2")


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame, bounds: dict[int, int], percent: int, known: tuple[DataFrame, DataFrame]) -> DataFrame:
    """a, b: links that join components (root) within a bucket (key), found block by block."""
    placed, pairs = block_pairs(members, sets, percent, known=known)
    placed, pairs = stage(placed, "placed"), stage(pairs, "block-pairs")
    name = ["key", "g", "i", "g2", "i2"]
    left = placed.join(pairs, ["key", "g", "i"]).select(*name, "c", "root", F.lit(True).alias("low"))
    right = placed.withColumnsRenamed({"g": "g2", "i": "i2"}).join(pairs.where("g <> g2 or i <> i2"), ["key", "g2", "i2"]).select(*name, "c", "root", F.lit(False).alias("low"))
    dealt = left.unionByName(right).join(nodes.select("c", "sig", "bands").join(sets, "c"), "c")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        c, root, low = (table[x].to_numpy(zero_copy_only=False) for x in ("c", "root", "low"))
        bands = np.frombuffer(b"".join(table["bands"].to_pylist()), np.int64).reshape(-1, BANDS)
        full = [np.frombuffer(x, np.uint64) for x in table["full"].to_pylist()]
        every = np.arange(len(c))
        left, right = (every, every) if key[1:3] == key[3:5] else (every[low], every[~low])
        found = compare_block(c, root, _matrix(table["sig"].combine_chunks()), bands, full, left, right, key[0].as_py(), bounds, percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return dealt.groupBy(*name).applyInArrow(compare, "a long, b long")


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles of a set of ``n`` can decide, if it is the smaller one of a linked pair, and if it is the larger one.

    A link shares at least 2 t / (1 + t) of the smaller set and at least t of the larger one.
    """
    return n + (-2 * percent * n // (100 + percent)) + 1, n + (-percent * n // 100) + 1


def rare_postings(pool: DataFrame, percent: int) -> DataFrame:
    """s, c, root, n, low: the deciding shingles of the sets in ``pool`` (c, root, full); low: as the smaller set of a pair.

    Shingles of one set only match nothing, but they come first in its order, so they are counted and not sent. Written.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in raw])), pa.array(np.frombuffer(b"".join(raw), np.int64))], ["c", "s"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for c, root, n, known in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                count, s = (x.to_numpy(zero_copy_only=False) for x in known.values.flatten())
                alone = n - len(s)
                low, high = (max(0, x - alone) for x in prefix_lengths(n, percent))
                first = np.lexsort((s, count))[:high]
                for column, x in zip(found, (s[first].tolist(), [c] * len(first), [root] * len(first), [n] * len(first), [k < low for k in range(len(first))]), strict=True):
                    column += x
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found[:4]), pa.array(found[4], pa.bool_())], ["s", "c", "root", "n", "low"])

    each = pool.select("c", "full").mapInArrow(explode, "c long, s long")
    # Written, so that the join has an exchange on either side, which adaptive execution can split.
    often = stage(each.groupBy("s").agg(F.count("*").alias("count")).where("count > 1"), "shingle-counts")
    known = each.join(often, "s").groupBy("c").agg(F.collect_list(F.struct("count", "s")).alias("known"))
    sized = pool.select("c", "root", (F.octet_length("full") / 8).cast("long").alias("n")).join(known, "c").select("c", "root", "n", "known")
    return stage(sized.mapInArrow(decide, "s long, c long, root long, n long, low boolean"), "postings")


def rare_blocks(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """s, i, j, c, root, n, low: what is compared, low rows against all others of each (s, i, j). Shingles that are low in no set, or are held by one component only, are left out."""
    heavy = lambda n, b: F.greatest(F.ceil(n / block), F.ceil(b * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    is_low = F.col("low").cast("int")
    sized = postings.groupBy("s").agg(F.count("*").alias("n_all"), F.sum(is_low).alias("n_low"), F.sum("n").alias("b_all"), F.sum(F.col("n") * is_low).alias("b_low"), F.min("root").alias("least"), F.max("root").alias("most"))
    kept = sized.where("n_low > 0 and least < most").select("s", heavy(F.col("n_low"), F.col("b_low")).alias("lows"), heavy(F.col("n_all"), F.col("b_all")).alias("alls"))
    met = postings.join(stage(kept, "kept-shingles"), "s")
    place = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    low = met.where("low").select("s", place("lows").alias("i"), every("alls").alias("j"), "c", "root", "n", F.lit(True).alias("low"))
    return low.unionByName(met.select("s", every("lows").alias("i"), place("alls").alias("j"), "c", "root", "n", F.lit(False).alias("low")))


def _by_rare_shingles(pool: DataFrame, nodes: DataFrame, sets: DataFrame, bounds: dict[int, int], percent: int, block: int) -> DataFrame:
    """a, b: links that join components (root) among all sets of ``pool`` (c, root), found over shared rare shingles."""
    postings = rare_postings(pool.join(sets, "c"), percent)
    dealt = rare_blocks(postings, block).join(nodes.select("c", "sig").join(sets, "c"), "c")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        c, root, n, low = (table[x].to_numpy(zero_copy_only=False) for x in ("c", "root", "n", "low"))
        full = [np.frombuffer(x, np.uint64) for x in table["full"].to_pylist()]
        found = compare_postings(c, root, n, low, _matrix(table["sig"].combine_chunks()), full, bounds, percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return dealt.groupBy("s", "i", "j").applyInArrow(compare, "a long, b long")


def compare_postings(c: np.ndarray, root: np.ndarray, n: np.ndarray, low: np.ndarray, sig: np.ndarray, full: list[np.ndarray], bounds: dict[int, int], percent: int) -> list[tuple[int, int]]:
    """Links between a low row and another row of its size or larger that join two components."""
    forest, out = _Forest(), []
    every = np.flatnonzero(~low)
    for k in np.flatnonzero(low).tolist():
        larger = (n[every] > n[k]) | ((n[every] == n[k]) & (c[every] > c[k]))
        other = every[larger & (root[every] != root[k]) & (percent * n[every] <= 100 * n[k])]
        if not len(other):
            continue
        alive, m = surviving(np.broadcast_to(sig[k], (len(other), VALUES)), sig[other], bounds)
        for x in other[alive][np.argsort(-m, kind="stable")].tolist():
            mine, its = forest.find(int(root[k])), forest.find(int(root[x]))
            if mine != its and similar(full[k], full[x], percent):
                forest.up[its] = mine
                out.append((min(int(c[k]), int(c[x])), max(int(c[k]), int(c[x]))))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, miss: float = 1e-5, with_keys: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (doc_id = component_id), a row for each row; the text's key (__lf_key) if asked."""
    bounds = least_matches(percent / 100, miss)
    rows = _sketches(docs, width)
    known = rows.where("h1 is not null and doc is not null")
    # A node is named by the number of the row that has its set and the smallest id.
    least = known.groupBy("h1", "h2").agg(F.min(F.struct("doc", "row", "key")).alias("x"))
    firsts = stage(least.select("h1", "h2", F.col("x.row").alias("c"), F.col("x.doc").alias("first"), F.col("x.key").alias("key")), "firsts")
    nodes = stage(known.select(F.col("row").alias("c"), "bands", "sig").join(firsts.select("c", "first"), "c").select("c", "first", "bands", "sig"), "nodes")
    buckets = _explode_bands(nodes)
    # Written, so that the join has an exchange on either side, which adaptive execution can split.
    shared = stage(buckets.groupBy("key").agg(F.min("c").alias("pivot"), F.max("c").alias("top"), F.count("*").alias("size")).where("pivot < top").select("key", "pivot", "size"), "shared")
    members = stage(buckets.join(shared, "key").select("key", "c", "pivot", "size"), "buckets")
    sets = _full_sets(docs, firsts.select("c", F.col("first").alias("doc"), "key").join(members.select("c").distinct(), "c", "left_semi"), width)
    release(docs.sparkSession)
    stars = members.where("c <> pivot").select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct()
    links = _Links(sets, percent)
    links.add(stage(_prune(stars, nodes, bounds), "stars"))
    # A bucket of two has been compared in full; larger ones may hold links between others than the pivot.
    several = stage(_rooted(members.where("size > 2"), links.roots, "c", "root").select("key", "c", "root"), "several")
    split = stage(several.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "split")
    mixed = stage(several.join(split, "key", "left_semi"), "mixed")
    if mixed.limit(1).count():
        known = cells_of(mixed, sets, block)
        wide = stage(wide_keys(known[1]), "wide")
        some = wide.limit(1).count()
        narrow = mixed.join(wide, "key", "left_anti") if some else mixed
        links.join(stage(_across(narrow, nodes, sets, bounds, percent, (known[0], known[1].join(wide, "key", "left_anti") if some else known[1])), "across"))
        if some:
            pool = stage(_rooted(mixed.join(wide, "key", "left_semi").select("c").distinct(), links.roots, "c", "root"), "pool")
            links.join(stage(_by_rare_shingles(pool, nodes, sets, bounds, percent, block), "rare"))
    labelled = _rooted(firsts.select("h1", "h2", "c", "first"), links.roots, "c", "root")
    lowest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    component = stage(labelled.join(lowest, "root").select("h1", "h2", "component_id"), "components")
    drop_staged(sets, nodes, members, mixed, several, shared)
    out = rows.select("doc", "key", "n", "h1", "h2").join(component, ["h1", "h2"], "left")
    keys = [F.col("key").alias("__lf_key")] if with_keys else []
    # A row without an id belongs to no component, not even that of its copies.
    mine = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    out = out.select(F.col("doc").alias("doc_id"), *keys, F.col("n").alias("n_shingles"), mine.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), sides AS (
  SELECT x, y FROM link UNION SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sizes UNION SELECT reach.node, sides.y FROM reach JOIN sides ON sides.x = reach.other
), component AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN component ON component.node = d.doc_id
"""
