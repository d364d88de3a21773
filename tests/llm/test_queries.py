"""The registered queries and the pipeline on the smallest tables."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumafold.llm import queries
from lumafold.session import table


def rows(names, found):
    """Rows with their columns by name; nulls and integers stay as they are."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    made, told = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    assert sorted(made.columns) == sorted(told.columns)
    assert rows(made.columns, made.collect()) == rows(told.columns, told.fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op1_bradley_terry"](spark, sf).where("held_out")
    met = scored.join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()
    assert {r["quality"]: r["p"] > 0.9 for r in met} == {0: False, 1: True} and all(r["p"] < 0.1 for r in met if r["quality"] == 0)


def test_language_model_beats_its_base(spark):
    from lumafold.llm.brown_lm import perplexity

    row = queries.QUERIES["op10_brown_classes"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), perplexity(F.sum("score"), F.sum("n_tokens")).alias("p")).first()
    assert row["s"] > row["b"] and row["p"] > 1


def brute_pipeline(docs):
    """All stages but the first, in plain Python; the first takes its verdicts from SQL."""
    from tests_brute import brute_components, brute_cut, brute_line_texts

    docs = brute_line_texts(docs)
    roots, _ = brute_components(list(docs.items()))
    docs = {i: t for i, t in docs.items() if roots[i] == i}
    return brute_cut(docs, 50)


def test_pipeline_equals_brute_force(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    verdict = dict(con.sql(f"SELECT doc_id, kept FROM ({queries.ORACLES['op2_divergence_rules']})").fetchall())
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect() if verdict[r["doc_id"]]}
    docs = brute_pipeline(docs)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in docs.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        head, start, k = len(ids) % 1024 or 1024, 0, 0
        for n in [head] + [1024] * ((len(ids) - head) // 1024) if len(ids) > 1024 else [len(ids)]:
            want.add((i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start, k = start + n, k + 1
    packed = corpus_pipeline.run(spark, sf)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect()} == want
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert sums.where("n <> m OR n > 1024").count() == 0


def test_stages_keep_columns_and_take_odd_rows(spark, make, odd, sf):
    docs = make(odd)
    for name, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= len(odd)
    empty = docs.limit(0)
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, empty, sf).count() == 0
