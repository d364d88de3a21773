"""Many equal rows under one id, or without one: work in proportion to the rows, and the same results as by brute force."""

import time

import pytest
from pyspark.sql import functions as F
from tests_brute import brute_cut, brute_line_texts

from lumafold.llm import line_dedup, near_dup, substring_dedup

PAGE = "\n".join(f"line {k} of the page that all share with word{k % 7} and word{k % 5}" for k in range(40))
OTHER = "\n".join(f"line {k} of the page that all share with word{k % 7} and word{k % 5}" for k in range(20, 60))


def docs_of(spark, n, ids, extra):
    many = spark.range(n).select((F.col("id") + 10 if ids else F.lit(None).cast("long")).alias("doc_id"), F.lit(PAGE).alias("text"))
    return many.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).repartition(4)


@pytest.mark.parametrize("work", [line_dedup.dedup_digest, substring_dedup.dedup_digest])
def test_equal_rows_without_an_id_cost_no_more_than_rows_with_ids(spark, work):
    took = {}
    for ids in (True, False):
        start = time.time()
        found = work(docs_of(spark, 20_000, ids, [(1, OTHER)])).groupBy("n_removed").count().collect()
        took[ids] = time.time() - start
        assert sum(r["count"] for r in found) == 20_001
    assert took[False] < 2 * took[True] + 5, took


@pytest.mark.parametrize("doc", [5, None])
def test_equal_rows_of_one_id_lose_what_one_row_loses(spark, doc):
    """A row without an id comes after all others; rows of one id remove nothing of each other."""
    import hashlib

    docs = spark.createDataFrame([(1, OTHER)] + [(doc, PAGE)] * 300, "doc_id long, text string").repartition(3)
    cut = brute_cut({1: OTHER, 5: PAGE}, 50)
    lines = brute_line_texts({1: OTHER, 5: PAGE})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, sha(" ".join(cut[1].split())))] + [(doc, sha(" ".join(cut[5].split())))] * 300
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["kept_sha256"])) for r in substring_dedup.dedup_digest(docs).collect())
    want = [(1, sha(lines[1]))] + [(doc, sha(lines[5]))] * 300
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["kept_sha256"])) for r in line_dedup.dedup_digest(docs).collect())


def test_equal_rows_are_one_near_duplicate_node(spark):
    docs = docs_of(spark, 3_000, False, [(1, PAGE), (2, PAGE + " more"), (2, PAGE + " more")])
    found = near_dup.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {(r["doc_id"], r["component_id"], r["kept"], r["count"]) for r in found} == {(1, 1, True, 1), (2, 1, False, 2), (None, None, True, 3000)}
