"""op8 sends queries around in packs: joins broadcast no more rows than there are blocks, and packs lose nothing."""

import numpy as np
from pyspark.sql import functions as F

from lumafold.llm import mtree_search


def broadcast_rows(spark, since):
    """The rows of each broadcast of the executions from number ``since`` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed, rows = store.executionsList(), []
    for execution in (listed.apply(k).executionId() for k in range(listed.size())):
        if execution < since:
            continue
        values = {int(k): v for k, v in spark._jvm.scala.jdk.CollectionConverters.MapHasAsJava(store.executionMetrics(execution)).asJava().items()}
        nodes = store.planGraph(execution).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                metrics = (node.metrics().apply(k) for k in range(node.metrics().size()))
                rows += [int(values[m.accumulatorId()].replace(",", "")) for m in metrics if m.name() == "number of output rows" and m.accumulatorId() in values]
    return rows


def test_queries_are_not_broadcast(spark):
    """Vectors that defy pruning: nearly each pair of a query and a block is searched, and none of them goes through the driver."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = 1 + max(listed.apply(k).executionId() for k in range(listed.size()))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(1200)
    ids[-3:] = 20, 40, 60  # these ask twice, with another vector
    table = spark.createDataFrame([(int(k), v) for k, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>")
    counts = {}
    got = sorted(tuple(r) for r in mtree_search.top_k(table, F.col("id") % 5 == 0, k=6, block_rows=40, query_rows=16, counts=counts).collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows = broadcast_rows(spark, since)
    assert rows and max(rows) <= counts["blocks"] < 240 < counts["kept"] <= counts["reached"] <= counts["possible"]
    ints, want = np.floor(64 * x).astype(np.int64), []
    for q in sorted(set(ids[ids % 5 == 0].tolist())):
        found = [(-int(score), int(k)) for row in np.flatnonzero(ids == q) for k, score in zip(ids, ints @ ints[row], strict=True) if k != q]
        want += [(q, n + 1, k, -score) for n, (score, k) in enumerate(sorted(found)[:6])]
    assert got == sorted(want)


def test_products_are_exact_in_each_type():
    """Vectors whose products fit float32, float64, 64-bit integers and neither: the same rows as Python's integers give."""
    rng = np.random.default_rng(2)
    for size in (100, 1 << 20, 1 << 28, 1 << 33):
        ints = rng.integers(-size, size, (700, 5))
        ints[300:320] = ints[300] + rng.integers(0, 2, (20, 5))
        exact = [[int(c) for c in v] for v in ints]
        lengths = np.array([float(sum(c * c for c in v)) for v in exact])
        tree = mtree_search.MTree(np.column_stack([ints.astype(float), np.sqrt(lengths.max() - lengths)]))
        asked, ids = ints[295:325], np.arange(700)
        scores = [[sum(a * b for a, b in zip(q, v, strict=True)) for v in exact] for q in asked.tolist()]
        want = [sorted((k for k in range(700) if k != 295 + n), key=lambda k: (-scores[n][k], k))[:9] for n in range(30)]
        for floors in (np.full(30, -np.inf), np.array([float(scores[n][want[n][8]]) for n in range(30)])):
            rows, found = mtree_search.search_tree(tree, ints, ids, lengths.max(), asked, ids[295:325], floors, 9)
            assert rows.tolist() == want and found.tolist() == [[scores[n][k] for k in want[n]] for n in range(30)]
