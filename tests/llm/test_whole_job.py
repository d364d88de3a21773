"""Inputs on which an operator once stopped short of the whole job."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumafold.llm import common, line_dedup, mtree_search, near_dup, pairwise_quality, substring_dedup
from lumafold.llm.components import connected_components


def roots_of(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    return {x: find(x) for x in list(up)}


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    names = iter([rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)])
    chain = [next(names) for _ in range(1200)]
    edges = [(chain[k], chain[k + s]) for s in (1, 2) for k in range(len(chain) - s)]
    hub = [next(names) for _ in range(60)]
    edges += [(hub[0], x) for x in hub[1:]] + [(7, 7), (5, 6), (6, 5), (6, 8)]
    edges += [(k, k + 1) for k in range(1000, 1300)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(table).collect()}
    assert got == roots_of([e for e in edges if e[0] != e[1]])
    with pytest.raises(RuntimeError):
        connected_components(table, max_rounds=1)
    assert connected_components(table.limit(0)).count() == 0


def lines_that_stay(rows, width=3):
    """Texts after line dedup, each row by itself: a window is late if a smaller id has it, or the row itself had it before."""
    key = lambda i: float("inf") if i is None else i
    cut = [t.split("\n") for _, t in rows]
    first = {}
    for (i, _), lines in zip(rows, cut, strict=True):
        for k in range(len(lines) - width + 1):
            w = tuple(lines[k : k + width])
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for (i, _), lines in zip(rows, cut, strict=True):
        seen, gone = set(), set()
        for k in range(len(lines) - width + 1):
            w = tuple(lines[k : k + width])
            if w in seen or first[w] < key(i):
                gone.update(range(k, k + width))
            seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [100_000, 0])
def test_line_windows_of_rows_that_share_an_id(make, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_REPEATED", few)
    block = ["s1 s", "s2 s", "s3 s"]
    own = lambda name, n: [f"{name}{k} line" for k in range(n)]
    long_late = own("a", 8) + block  # its ninth window is a copy
    rows = [(1, "\n".join(block)), (None, "\n".join(long_late)), (None, "\n".join(own("b", 4))), (None, "\n".join(own("c", 20)))]
    rows += [(5, "\n".join(long_late + ["z"])), (5, "\n".join(own("d", 3))), (5, "\n".join(own("e", 30))), (5, "\n".join(long_late + ["z"]))]
    want = lines_that_stay(rows)
    got = line_dedup.dedup_lines(make(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want
    digests = line_dedup.dedup_digest(make(rows)).collect()
    assert sorted((str(r["doc_id"]), r["kept_sha256"]) for r in digests) == sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in want)


def words_that_stay(rows, length):
    """Texts after substring dedup, each row by itself."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - length + 1):
            s = tuple(w[k : k + length])
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t in rows:
        w = t.split()
        gone = {j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < key(i) for j in range(k, k + length)}
        out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [100_000, 0])
@pytest.mark.parametrize("whole", [True, False])
def test_substrings_of_rows_that_share_an_id(make, monkeypatch, few, whole):
    monkeypatch.setattr(common, "FEW_REPEATED", few)
    own = lambda name, n: [f"{name}{k}" for k in range(n)]
    passage = own("p", 60)
    copy = passage if whole else own("x", 90) + passage
    rows = [(1, passage), (None, copy), (None, own("a", 55)), (None, own("b", 200)), (5, own("c", 52)), (5, copy), (5, own("d", 300))]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = words_that_stay(rows, 50)
    got = substring_dedup.dedup_substrings(make(rows), 50).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want
    digests = substring_dedup.dedup_digest(make(rows), 50).collect()
    assert sorted((str(r["doc_id"]), r["kept_sha256"]) for r in digests) == sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in want)


def test_filters_judge_rows_not_ids(spark, make):
    own = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    again = " ".join(["over and over again we say"] * 10)  # fails the base rule
    rows = [(None, "short"), (None, own("clean", 40)), (7, again), (7, own("fine", 40)), (7, None), (8, own("good", 30))]
    left = corpus_pipeline.quality_rules(spark, make(rows), "")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, (rows[1], rows[3], rows[5])))
    rows = [(1, own("a", 60)), (2, own("a", 60)), (2, own("b", 60)), (None, own("a", 60)), (None, own("c", 60))]
    left = corpus_pipeline.near_duplicates(spark, make(rows), "")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, (rows[0], *rows[2:])))


@pytest.mark.parametrize("large", [1e5, 1e7])
def test_tree_search_keeps_large_vectors(spark, large):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[::37] *= large
    x[40], x[41], x[42] = large, large, large + 1 / 64
    x[60], x[61], x[62] = -large, large * (1 + rng.normal(size=16) * 1e-7), -large
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = mtree_search.top_k(table, F.col("id") % 20 == 0, k=7, block_rows=64, query_rows=8, max_pivots=5)
    ints = [[int(c) for c in np.floor(64 * v)] for v in x]
    want = set()
    for q in range(0, 400, 20):
        scores = [sum(a * b for a, b in zip(ints[q], v, strict=True)) for v in ints]
        order = sorted((k for k in range(400) if k != q), key=lambda k: (-scores[k], k))[:7]
        want |= {(q, n + 1, k, scores[k]) for n, k in enumerate(order)}
    assert max(abs(s) for *_, s in want) < 1 << 63
    assert {tuple(r) for r in got.collect()} == want


def test_rows_with_equal_ids_but_other_texts_train_once(make, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 60)], "doc_id long, quality int, toxic int")
    rows = [(k, ("nice words in a row here" if k % 2 else "BAD $$$ !!!") + f" {copy}") for k in range(1, 60) for copy in range(9)]
    raw, good = pairwise_quality.training_rows(make(rows), labels, 20)
    assert len(raw) == len(good) == 20
    again, _ = pairwise_quality.training_rows(make(rows[::-1]), labels, 20)
    assert (raw == again).all()


def test_hot_id_with_many_texts(make):
    """Rows of one id with different texts: each meets its own set only."""
    own = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(5, own(f"t{k % 300}_", 30)) for k in range(600)] + [(k, own(f"t{k}_", 30)) for k in range(6, 12)]
    got = near_dup.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {5}
