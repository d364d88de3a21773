"""Operators against brute-force versions on small fixtures, with odd rows among them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer
from pyspark.sql import functions as F
from tests_brute import brute_components

from lumafold.llm import brown_lm, byte_bpe, divergence, line_dedup, mtree_search, near_dup, packing, pairwise_quality, sstable, substring_dedup

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
GAP = re.compile(r"[^\x20\x09-\x0D]+")


#: Texts that hold special tokens, as they are written and otherwise.
SPECIAL = [(700, "hello <|endoftext|> world"), (701, "<|startoftext|><|endoftext|>"), (702, "a <|ENDOFTEXT|> b <|endoftext"), (703, "x<|endoftext|>y\n<|endoftext|> z")]


def some(rng, n, prefix="w", size=400):
    return [f"{prefix}{rng.randrange(size)}" for _ in range(n)]


def corpus(rng):
    """Families around the threshold, copies, shared passages and short texts."""
    base = some(rng, 160)
    passage = some(rng, 70, "p")
    rows = []
    for k in range(60):
        text = list(base)
        for _ in range(k % 9):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(text))
    for k in range(30):
        rows.append(" ".join(some(rng, 40 + k) + passage[: 40 + k] + some(rng, 30)))
    rows += [rows[3]] * 8 + ["a b c", "A b C", "a b c d e", "a b c d e f"]
    return list(enumerate(rows, 10))


def test_near_duplicates(make, rng, odd):
    rows = corpus(rng) + [(i if i is None else 1000 + i, t) for i, t in odd]
    want, sets = brute_components(rows)
    got = near_dup.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
        assert r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None)
    assert near_dup.near_duplicates(make([])).count() == 0


def test_blocks_find_links_beyond_the_pivot(make, rng):
    """A chain whose ends aren't alike: links lie between others than a bucket's pivot."""
    text = some(rng, 300)
    rows = []
    for k in range(25):
        for at in range(12 * k, 12 * k + 4):
            text[at % 300] = f"c{k}_{at}"
        rows.append((k, " ".join(text)))
    want, _ = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(make(rows)).collect()} == want


def test_large_components_of_a_bucket_meet_only_where_they_may_link(spark):
    """A bucket of 20,000 with two components far apart: a row a member, not a row a member and block."""
    rng = np.random.default_rng(4)
    base = [np.sort(rng.integers(0, 1 << 63, 60, np.uint64)) for _ in range(3)]
    members, sets = [], []
    for c in range(20_003):
        g = c % 2 if c < 20_000 else 2
        own = base[g].copy()
        own[rng.integers(60)] = rng.integers(1 << 63)
        members.append((7, c, g if c < 20_000 else c))
        sets.append((c, np.sort(own).tobytes()))
    members = spark.createDataFrame(members, "key long, c long, root long")
    placed, pairs = near_dup.block_pairs(members, spark.createDataFrame(sets, "c long, full binary"), 85, block=2048)
    assert placed.count() == 20_003
    met = [tuple(r) for r in pairs.collect()]
    assert all(p[1] == near_dup.SMALL or p[3] == near_dup.SMALL for p in met) and len(met) == 5 + 5 + 1


def test_posterior_bounds():
    bounds = near_dup.least_matches(0.85, 1e-5)
    assert list(bounds) == list(range(36, 253, 36))
    assert all(0.6 < m / n < 0.85 for n, m in bounds.items() if n > 36)
    assert sorted(bounds.values()) == list(bounds.values())


def brute_removed(rows, length):
    first = {}
    for i, t in rows:
        w = GAP.findall(t or "")
        key = math.inf if i is None else i
        for k in range(len(w) - length + 1):
            s = tuple(w[k : k + length])
            first[s] = min(first.get(s, key), key)
    out = {}
    for i, t in rows:
        w = GAP.findall(t or "")
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (math.inf if i is None else i):
                gone.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i, t] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_difference_cover_meets_every_shift():
    p, d = substring_dedup.PERIOD, substring_dedup.COVER
    assert all(any((a + k) % p in d and (b + k) % p in d for k in range(p)) for a in range(p) for b in range(p))


def test_substring_dedup(make, rng, odd):
    rows = corpus(rng) + odd
    rows += [(300, " ".join(some(rng, 49))), (301, " ".join(["same"] * 120)), (302, " ".join(["same"] * 70))]
    want = brute_removed(rows, 50)
    for r in substring_dedup.dedup_digest(make(rows, extra=False).withColumn("t", F.col("text")), 50).collect():
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) in [v for (i, _), v in want.items() if i == r["doc_id"]]
    cut = substring_dedup.dedup_substrings(make(rows), 50)
    assert cut.count() == len(rows) and {"doc", "late", "n_removed"} <= set(cut.columns)
    assert substring_dedup.dedup_digest(make([]), 50).count() == 0


def brute_lines(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = [] if t is None else t.split("\n")
        at = [k for k, x in enumerate(lines) if GAP.search(x)]
        gone = set()
        for k in range(len(at) - 2):
            s = tuple(lines[j] for j in at[k : k + 3])
            if s in seen:
                gone.update(at[k : k + 3])
            seen[s] = i
        out[i] = (len(lines), len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(lines) if k not in gone).encode()).hexdigest())
    return out


def test_line_dedup(make, rng, odd):
    block = ["alpha a", "beta b", "gamma c", "delta d"]
    rows = [(k, "\n".join(some(rng, 2) + block[: 3 + k % 2] + [""] * (k % 3) + some(rng, 2) + block)) for k in range(10, 20)]
    rows += [(30, "x\n\ny\n\nz"), (31, "x\ny\nz"), (32, "x\ny")] + [(40 + k, t) for k, (i, t) in enumerate(odd) if i is not None]
    want = brute_lines(rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in line_dedup.dedup_digest(make(rows)).collect()}
    assert got == want
    cut = line_dedup.dedup_lines(make(rows))
    assert cut.count() == len(rows) and cut.where("n_removed > 0").count() > 0
    assert line_dedup.dedup_lines(make(odd)).where("text IS NULL").count() == 1 and line_dedup.dedup_digest(make([])).count() == 0


def test_packing(make, rng, odd):
    rows = [(k, " ".join(some(rng, rng.choice((1, 30, 300, 900, 2500))))) for k in range(10, 90)] + odd + SPECIAL
    packed = packing.pack_documents(make(rows), BYTE).collect()
    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        sizes = packing.cut_lengths(len(ids), 1024)
        assert sum(sizes) == len(ids) and all(s == 1024 for s in sizes[1:])
        start = 0
        for k, n in enumerate(sizes):
            want[i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    _, _, fill = packing.best_fit([r["length"] for r in packed], 1024)
    assert len(bins) <= len(fill) * 1.03 + 1
    assert packing.pack_documents(make([]), BYTE).count() == 0


def test_packing_merges_over_many_groups(spark, rng):
    rows = [(k, 0, 0, rng.choice((100, 300, 400, 700)), 0) for k in range(600)]
    pieces = spark.createDataFrame(rows, packing.PIECES).repartition(20)
    from lumafold.llm.common import stage

    out = packing.pack(stage(pieces, "test-pieces"), 1024, fan_in=4)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert sums.where("n <> m OR n > 1024").count() == 0 and out.count() == 600
    _, _, fill = packing.best_fit([r[3] for r in rows], 1024)
    assert sums.count() <= len(fill) * 1.03 + 1


def test_packing_does_not_depend_on_batches(spark, rng):
    """Groups are counts of pieces, not Arrow batches; several groups of one partition merge."""
    from lumafold.llm.common import stage

    rows = [(k, 0, 0, rng.randrange(1, 1025), 0) for k in range(3000)]
    pieces = stage(spark.createDataFrame(rows, packing.PIECES).coalesce(2), "test-pieces")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), {}
    try:
        for group_rows in (1 << 18, 500):
            for batch in ("7", "1000"):
                spark.conf.set(key, batch)
                out = packing.pack(pieces, 1024, group_rows=group_rows)
                seen.setdefault(group_rows, []).append(sorted(map(tuple, out.select("doc_id", "sequence_id", "offset").collect())))
                sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
                assert sums.where("n <> m OR n > 1024").count() == 0 and out.count() == 3000
    finally:
        spark.conf.set(key, before)
    for one, other in seen.values():
        assert one == other
    _, _, fill = packing.best_fit([r[3] for r in rows], 1024)
    assert all(len({s for _, s, _ in runs[0]}) <= len(fill) * 1.02 + 1 for runs in seen.values())


def test_carry_loses_no_join(rng):
    """Of the bins that best-fit leaves, at most one is half full or less, so none that a group keeps back could join another."""
    for _ in range(50):
        _, _, fill = packing.best_fit([rng.randrange(1, 1025) for _ in range(rng.randrange(1, 300))], 1024)
        under = sorted(fill)
        assert sum(2 * f <= 1024 for f in fill) <= 1 and all(a + b > 1024 for a, b in zip(under, under[1:]))


def test_shards(make, rng, odd, tmp_path):
    rows = [(k, " ".join(some(rng, rng.randrange(1, 60), "Word"))) for k in range(10, 400)] + odd + SPECIAL
    path = f"file://{tmp_path}/sst"
    manifest = sstable.write_shards(make(rows), WORD, path, shard_bytes=20_000)
    assert manifest.count() > 3
    got = sstable.read_shards(manifest, path).collect()
    plain = Tokenizer.from_file(WORD)
    start = 0
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    for r, (i, t) in zip(sorted(got, key=lambda r: r["start"]), ordered, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    files = sorted((tmp_path / "sst").glob("*.sst"))
    assert sorted(r["file"] for r in manifest.collect()) == [f.name for f in files]
    found = sstable.lookup(manifest, path, [57, 4, None, 10**6, 57]).collect()
    of = lambda i: [*plain.encode(i or "", add_special_tokens=False).ids, 1]
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in found) == sorted((str(i), of(t)) for i, t in rows if i in (57, 4, None))
    with pytest.raises(ValueError):
        sstable.lookup(manifest, path, list(range(sstable.MOST_WANTED + 1)))
    readers = [sstable.ShardReader(f.open("rb")) for f in files]
    texts = dict(rows)
    for i in (0, 10, 57, 399, None):
        found = [v for r in readers if (v := r.get(i)) is not None]
        assert [np.frombuffer(v, "<u4").tolist() for v in found] == [[*plain.encode(texts[i] or "", add_special_tokens=False).ids, 1]]
    assert all(r.get(10**6) is None and r.get(4, 2) is None for r in readers)
    assert sum(r.may_have(k) for r in readers for k in range(10**6, 10**6 + 300)) < 0.05 * 300 * len(readers)
    assert sstable.round_trip(make([]), WORD).count() == 0


def test_shards_split_a_hot_id(make, rng, tmp_path):
    """A third of the rows have no id and a third share one: both fill several shards, and lookups find all of them."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(some(rng, 40, "Word"))) for k in range(1800)] + [(7, "the same")] * 20 + [(7, None), (7, "")]
    path = f"file://{tmp_path}/sst"
    manifest = sstable.write_shards(make(rows), WORD, path, shard_bytes=20_000)
    shards = sorted((r["shard"], r["n_docs"], r["first_key"], r["last_key"]) for r in manifest.collect())
    assert len(shards) > 10 and max(s[1] for s in shards) < len(rows) / 4
    assert all(a[3][:9] <= b[2][:9] for a, b in zip(shards, shards[1:]))
    plain = Tokenizer.from_file(WORD)
    of = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    got = sorted(sstable.read_shards(manifest, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(i), zlib.crc32(of(t))) for i, t in rows)
    found = sstable.lookup(manifest, path, [7, None, 2]).collect()
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in found) == sorted((str(i), of(t)) for i, t in rows if i in (7, None, 2))


def test_byte_bpe(make, rng, odd):
    ranks = byte_bpe.load_ranks(MULTI)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = ["a", "b'", "'s", " ", "  ", "\n", "\t", "1", "é", "!", "aaaa", "the", "日本", "ing", " x", "\U0001f600", "\xa0", "\x1c", ".", "The"]
    rows = odd + [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(10, 500)] + [(900, "a" * 30_000), (901, "ab" * 20_000)]
    texts = Counter()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        texts[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = byte_bpe.digests(make(rows), MULTI, public_tokenizers.PATTERN).collect()
    assert Counter(tuple(r) for r in got) == texts
    encoded = byte_bpe.encode_documents(make(rows), MULTI, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_ids(encoded, MULTI, public_tokenizers.PATTERN)
    assert Counter(bytes(r["decoded"]) for r in decoded.collect()) == Counter((t or "").encode() for _, t in rows)
    assert byte_bpe.digests(make([]), MULTI, public_tokenizers.PATTERN).count() == 0


def test_tree_search(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 8))
    rows = [(k, (centers[k % 6] + 0.1 * rng.normal(size=8)).astype(float).tolist(), "x") for k in range(600)]
    rows += [(1000 + k, rows[5][1], "x") for k in range(300)]
    bad = [(2000, None, "x"), (2001, [float("nan")] * 8, "x"), (2002, [None] * 8, "x"), (None, rows[0][1], "x"), (2020, [1.0] * 3, "x"), (2040, [], "x")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, home string")
    got = mtree_search.top_k(table, F.col("id") % 20 == 0, k=7, block_rows=64, query_rows=8, max_pivots=5)
    ids = np.array([r[0] for r in rows])
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [k for k in np.lexsort((ids, -score)) if k != q][:7]
        want |= {(int(ids[q]), n + 1, int(ids[k]), int(score[k])) for n, k in enumerate(order)}
    assert {tuple(r) for r in got.collect()} == want
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, home string")
    assert mtree_search.top_k(few, F.col("id") % 20 == 0, k=7).count() == 2
    assert mtree_search.top_k(few.limit(0), F.col("id") % 20 == 0).count() == 0


def test_blocks_are_small_balls(spark):
    """Clusters larger than a block are split again and again; most blocks are ruled out, and equal vectors still fill several blocks."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 16))
    x = centers[rng.integers(0, 8, 1500)] + 0.02 * rng.normal(size=(1500, 16))
    x[:400] = x[0]
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    placed = mtree_search.near_blocks(mtree_search.whole_vectors(table, 64), 50, 8).toPandas()
    assert sorted(placed["id"]) == list(range(1500)) and placed["block"].nunique() > 30
    assert placed[placed["id"] < 400]["block"].nunique() >= 8  # dealt out by hash
    assert placed.groupby("block")["page"].nunique().max() == 1 and placed["home"].nunique() <= 9
    counts = {}
    got = {tuple(r) for r in mtree_search.top_k(table, F.col("id") % 20 == 0, k=5, block_rows=50, max_pivots=8, counts=counts).collect()}
    ints = np.floor(64 * x).astype(np.int64)
    want = set()
    for q in range(0, 1500, 20):
        score = ints @ ints[q]
        want |= {(q, n + 1, int(k), int(score[k])) for n, k in enumerate([k for k in np.lexsort((np.arange(1500), -score)) if k != q][:5])}
    assert got == want
    assert counts["kept"] <= counts["reached"] < counts["possible"] / 2


def test_tree_skips_pages():
    rng = np.random.default_rng(1)
    ints = np.concatenate([rng.integers(-5, 5, (400, 4)) + c for c in ((200, 0, 0, 0), (0, 200, 0, 0), (0, 0, 200, 0))]).astype(np.int64)
    length2 = float((ints**2).sum(1).max())
    tree = mtree_search.MTree(np.column_stack([ints, np.sqrt(length2 - (ints**2).sum(1))]).astype(float))
    looked = []
    for page in tree.pages:
        if page["rows"] is not None:

            class Watched(np.ndarray):
                def __getitem__(self, key):
                    looked.append(self)
                    return super().__getitem__(key)

            page["rows"] = page["rows"].view(Watched)
    rows, _ = mtree_search.search_tree(tree, ints, np.arange(1200), length2, ints[:1], np.array([0]), np.array([-np.inf]), 5)
    assert (rows[0] < 400).all() and len(looked) < sum(p["rows"] is not None for p in tree.pages)


def test_language_model(make, rng, odd):
    rows = [(k, " ".join(rng.choice(["The", "the", "cat,", "dog", "sat", f"x{rng.randrange(300)}"]) for _ in range(rng.randrange(60)))) for k in range(10, 200)] + odd
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(i, [*GAP.findall((t or "").translate(low)), None]) for i, t in rows]
    c = Counter(w for i, ws in toks if not fold(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, fold(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in toks)
    for head in (1 << 18, 50):
        got = brown_lm.score_documents(make(rows), head_words=head, cluster_words=20, classes=4).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert brown_lm.score_documents(make([])).count() == 0


def likelihood(pairs, label):
    member = np.eye(label.max() + 1)[label]
    grid = member.T @ pairs @ member
    nlogn = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return nlogn(grid) - nlogn(grid.sum(0)) - nlogn(grid.sum(1))


def test_exchange_ends_where_no_single_move_helps():
    for seed in range(4):
        pairs = np.random.default_rng(seed).poisson(3, (14, 14)).astype(float)
        label = brown_lm.exchange_clusters(pairs, 12, 3, passes=50)
        assert label[12:].tolist() == [3, 4]
        start = np.array([k % 3 for k in range(12)] + [3, 4])
        best = likelihood(pairs, label)
        assert best > likelihood(pairs, start)
        for w in range(12):
            for k in range(3):
                moved = label.copy()
                moved[w] = k
                assert likelihood(pairs, moved) <= best + 1e-6


def test_model_probabilities_sum_to_one(make, rng):
    rows = [(k, " ".join(rng.choice(["a", "bb", "ccc", "d,", "longer"]) for _ in range(30))) for k in range(60)]
    docs = brown_lm._rows(make(rows)).where("not held_out")
    from lumafold.llm.common import stage

    m = brown_lm.train(docs, stage(brown_lm.word_counts(docs), "t"), 1000, 3, 2, 0.5, 0.75)
    assert np.allclose((10**m.transition).sum(1), 1)
    for k in range(m.first_shape):
        assert (10 ** m.emission[m.label == k]).sum() == pytest.approx(1)


def test_language_model_scores_by_the_definition(make, rng, odd):
    """The scores of all documents, from the classes that were learned and plain counts."""
    from lumafold.llm.common import stage

    pool = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(pool[min(int(rng.expovariate(0.08)), 59)] + rng.choice(["", "", ","]) for _ in range(rng.randrange(50)))) for k in range(10, 150)] + odd + [(900, "Zz " * 5000)]
    docs = brown_lm._rows(make(rows)).where("not held_out")
    m = brown_lm.train(docs, stage(brown_lm.word_counts(docs), "t"), 1 << 18, 12, 5, 0.5, 0.75)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, GAP.findall((t or "").translate(low))) for i, t in rows]
    trained = [w for i, w in texts if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for w in trained for x in w)
    own = {w.decode(): int(m.label[k]) for w, k in m.head.items() if m.label[k] < m.first_shape}
    assert {w for w, n in c.items() if n >= 3 and len(w.encode()) <= 64} <= set(own) and len(own) > 12
    of = lambda w: own.get(w, m.first_shape + brown_lm.shape(w.encode()))
    size = m.end + 1
    grid = np.zeros((size, size))
    for w in trained:
        kinds = [m.end, *map(of, w), m.end]
        for a, b in zip(kinds, kinds[1:]):
            grid[a, b] += 1
    class_n, class_v = Counter(), Counter()
    for w, n in c.items():
        class_n[of(w)] += n
        class_v[of(w)] += 1

    def chance(a, b):
        base = (grid[:, b].sum() + 0.5) / (grid.sum() + 0.5 * size)
        return base if not grid[a].sum() else (max(grid[a, b] - 0.75, 0) + 0.75 * (grid[a] > 0).sum() * base) / grid[a].sum()

    def emitted(w):
        k = of(w)
        return c[w] / class_n[k] if k < m.first_shape else (c[w] + 0.5) / (class_n[k] + 0.5 * (class_v[k] + 1))

    want = Counter()
    for i, w in texts:
        kinds = [m.end, *map(of, w), m.end]
        want[i, round(sum(math.log10(chance(a, b)) for a, b in zip(kinds, kinds[1:])) + sum(math.log10(emitted(x)) for x in w), 5)] += 1
    for head in (1 << 18, 20):
        got = Counter((r["doc_id"], round(r["score"], 5)) for r in brown_lm.score_documents(make(rows), head_words=head, cluster_words=12, classes=5).collect())
        if head > 20:
            assert got == want
        assert {i for i, _ in got} == {i for i, _ in want}


def test_words_join_the_class_that_raises_the_likelihood_most():
    rng = np.random.default_rng(2)
    grid, classes = rng.poisson(4, (9, 9)).astype(float), 6
    nlogn = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    counts = {w: rng.poisson(1, 18) * (rng.random(18) < 0.6) + (np.arange(18) == w) for w in range(7)}
    flat = [(w, p, n) for w, row in counts.items() for p, n in enumerate(row) if n]
    got = brown_lm.best_classes(*(np.array(x) for x in zip(*flat)), grid, classes)
    for w, row in counts.items():
        values = []
        for b in range(classes):
            joined = grid.copy()
            joined[:, b] += row[:9]
            joined[b, :] += row[9:]
            # What leads to a class or follows it counts wherever the word goes, so only the joined class's own totals change.
            rows, columns = grid.sum(1), grid.sum(0)
            rows[b] += row[9:].sum()
            columns[b] += row[:9].sum()
            cells = nlogn(grid) + sum(nlogn(np.array([grid[k, b] + row[k]])) - nlogn(grid[k, b : b + 1]) for k in range(9)) + sum(nlogn(np.array([grid[b, k] + row[9 + k]])) - nlogn(grid[b, k : k + 1]) for k in range(9))
            values.append(cells - nlogn(rows) - nlogn(columns))
        assert got[w] == int(np.argmax(values))


def brute_base(t):
    w = GAP.findall(t or "")
    times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + s for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for s in range(5)}
    lines = [x for x in (t or "").split("\n") if GAP.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_divergence(make, rng, odd):
    pool = "the of and to a in is that for it was on are with be".split() + ["house", "tree", "river", "stone", "walk", "green", "over"]
    clean = [(k, " ".join(rng.choice(pool) for _ in range(120)) + ".") for k in range(10, 60)]
    junk = [(100, "#### $$$$ %%%% " * 3 + " ".join(f"{k}#%$&" for k in range(120))), (101, " ".join(w.upper() + "!!" for _, t in clean[:2] for w in t.split()))]
    rep = [(110, "a b c d e f g h i j " * 5), (111, "x y\nx y\nz"), (112, "a b c d e a b c d e q r s t u v w x y z")]
    rows = clean + junk + rep + odd
    got = divergence.judge(make(rows, extra=False).withColumn("h", F.lit(1))).collect()
    want = Counter((i, *brute_base(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert all(verdict[i] for i, _ in clean) and not verdict[100] and not verdict[101]
    assert divergence.judge(make([])).count() == 0


def test_divergence_learns_words_and_limits(spark, make, rng):
    """Clean characters are not enough: a text without its language's common words goes; lengths have limits of their own."""
    speech = {lang: [f"{a}{b}" for a in part for b in "aeiou"] for lang, part in (("xx", "bdfgk"), ("yy", "lmnpr"))}
    rare = [f"{a}{b}{c}" for a in "stvwz" for b in "aeiou" for c in "bdlmn"]
    rows = []
    for k in range(400):
        lang = ("xx", "yy")[k % 2]
        rows.append((k, " ".join(rng.choice(speech[lang]) if rng.random() < 0.6 else rng.choice(rare) for _ in range((80, 300, 1500)[k % 3 % 2 + (k > 380)])), lang))
    rows += [(900, " ".join(rng.choice(rare) for _ in range(300)), "xx"), (901, " ".join(rng.choice(speech["yy"]) for _ in range(300)) + " x", "xx"), (902, None, None), (903, "x" * 300_000 + " " + " ".join(rng.choice(rare) for _ in range(3_000)), "yy")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in divergence.judge(table, top_words=25, max_class_distance=2.0).collect()}
    assert not got[900]["kept"] and not got[901]["kept"] and not got[902]["kept"] and not got[903]["kept"]
    assert not got[900]["base_failed"] and got[900]["word_distance"] > got[900]["word_limit"] and got[901]["language"] == "yy"
    assert sum(r["kept"] for i, r in got.items() if i < 400) >= 395
    assert len({r["word_limit"] for r in got.values() if r["language"] == "xx"}) > 1
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    want = con.sql(divergence.sql(top_words=25, max_class_distance=2.0)).fetchall()
    assert {r[0]: r[-1] for r in want} == {i: r["kept"] for i, r in got.items()}


def test_quality(make, spark, rng, odd):
    good = [(k, " ".join(some(rng, 80, "word"))) for k in range(10, 110)]
    bad = [(k, " ".join(["BUY!!", "$$$"] * 30 + some(rng, 10, "X"))) for k in range(200, 260)]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(10, 1, 0), (None, 1, 0), (11, None, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["doc_id"]): r for r in pairwise_quality.classify(make(good + bad + odd), table).collect()}
    for i, _ in good + bad:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == int(i < 200) == int(got[i]["score"] >= 0.3)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = pairwise_quality.classify(make(odd), table.limit(0)).collect()
    assert len(none) == len(odd) and {r["score"] for r in none} == {0.3}
    assert pairwise_quality.classify(make([]), table).count() == 0
