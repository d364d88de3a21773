"""Buckets of many small components: compared over rare shingles, in rows that grow with the members."""

import numpy as np
from tests_brute import brute_components

from lumafold.llm import near_dup


def own(name, n):
    return [f"{name}{k}" for k in range(n)]


def family(rng, n, base, changes):
    """Variants of one page, each with ``changes`` words of its own; every seventh is alike to the one before it."""
    rows = []
    for k in range(n):
        text = list(base)
        for c in range(changes):
            text[rng.randrange(len(text))] = f"v{k}_{c}"
        if k % 7 == 6:
            text = list(rows[-1])
            text[rng.randrange(len(text))] = f"again{k}"
        rows.append(text)
    return [" ".join(x) for x in rows]


def test_wide_buckets_lose_no_link(make, rng, monkeypatch):
    seen = []
    inner = near_dup._by_rare_shingles
    monkeypatch.setattr(near_dup, "_by_rare_shingles", lambda *a: seen.append(1) or inner(*a))
    texts = [t for changes in (1, 2, 3, 5) for t in family(rng, 90, own(f"b{changes}_", 110), changes)]
    rows = list(enumerate(texts + [" ".join(own("b2_", 110))] * 5, 10))
    want, _ = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(make(rows), block=4).collect()} == want
    assert seen


def pool_of(spark, n, shared=89, alone=11):
    """Sets that share ``shared`` shingles and have some of their own: about 0.8 alike, so none is linked."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, shared, np.uint64)
    rows = [(c, c, np.sort(np.append(base, rng.integers(0, 1 << 63, alone, np.uint64))).tobytes()) for c in range(n)]
    return spark.createDataFrame(rows, "c long, root long, full binary")


def test_rows_grow_with_members_not_with_their_square(spark):
    made = {}
    for n in (5_000, 20_000):
        pool = pool_of(spark, n)
        cells = near_dup.cells_of(pool.selectExpr("7L AS key", "c", "root"), pool.select("c", "full"))[1]
        assert [r["key"] for r in near_dup.wide_keys(cells).collect()] == ([7] if n > 10_000 else [])
        postings = near_dup.rare_postings(pool, 85)
        made[n] = postings.count(), near_dup.rare_blocks(postings).count()
    assert made[20_000][0] <= 4 * made[5_000][0] <= 20_000 * 16 and made[20_000][1] <= 4 * max(1, made[5_000][1])


def test_prefixes_decide_every_link():
    rng = np.random.default_rng(1)
    for _ in range(3_000):
        n = int(rng.integers(1, 40))
        a = rng.choice(60, n, replace=False)
        b = np.unique(np.append(rng.choice(a, int(rng.integers(0, n + 1)), replace=False), rng.integers(60, 70, int(rng.integers(0, 4)))))
        if not len(b) or not near_dup.similar(np.sort(a).astype(np.uint64), b.astype(np.uint64), 85):
            continue
        small, large = sorted((np.sort(a), b), key=len)
        low, high = near_dup.prefix_lengths(len(small), 85)[0], near_dup.prefix_lengths(len(large), 85)[1]
        assert set(small[:low]) & set(large[:high])
