"""Exact search against SQL and brute force; the pipeline stage by stage."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelscope.llm import pii, topk
from panelscope.llm.common import stored
from panelscope.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same
from tests.llm.conftest import SF
from tests.llm.test_dedup import plain_fingerprint


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_statement(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def plain_top(rows, k=5):
    usable = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for i in sorted({i for i, _ in usable if i % 50 == 0}):
        q = min(x for j, x in usable if j == i)
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in usable if j != i and len(x) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "scale"), [(4096, 1.0), (16, 1.0), (64, 1e3), (64, 1e6)])
def test_top_k(spark, block, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    draw = np.random.default_rng(9)
    rows = [(i, (np.round(draw.normal(size=8), 2 if i % 3 else 0) * scale).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [1.0] * 7 + [None]), (402, [1.0] * 7 + [math.nan]), (403, [math.inf] * 8), (None, [1.0] * 8), (450, [1.0] * 3), (451, [2.0] * 3), (10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "block": F.lit(2), "rank": F.lit(3)})
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == plain_top(rows)


def test_bounds_hold_at_every_depth():
    draw = np.random.default_rng(10)
    x, q = np.floor(draw.normal(size=(500, 16)) * 50), np.floor(draw.normal(size=(20, 16)) * 50)
    got = {i: (ids.tolist(), scores) for i, ids, scores in topk.block_top(np.arange(1000, 1020), q, np.arange(500), x, 5)}
    for i in range(20):
        scores = x @ q[i]
        best = np.lexsort((np.arange(500), -scores))[:5]
        assert got[1000 + i] == (best.tolist(), scores[best].astype(int).tolist())


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages(spark, docs):
    rows, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, SF), name)
        steps[name] = rows
    assert list(steps) == ["language", "near_dedup", "personal_data", "mixture", "packing"]
    for name in list(steps)[:-1]:
        assert steps[name].columns == docs.columns
    ids = {name: [r["doc_id"] for r in steps[name].select("doc_id").collect()] for name in list(steps)[:-1]}
    # language: only texts without known letters go
    gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - set(ids["language"])
    assert {9001, 9002, 9003, 9009} - {9009} <= gone <= {None, 9001, 9002, 9003, 9009, 9010, 9008, 9011}
    # near-duplicates: one of each group
    prints = [plain_fingerprint(r["text"]) for r in steps["near_dedup"].collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    # personal data: none of the strict kinds is left
    left = pii.find_spans(steps["personal_data"]).where("n_email + n_ip + n_card + n_phone > 0").count()
    assert left == 0 and sorted(map(str, ids["personal_data"])) == sorted(map(str, ids["near_dedup"]))
    # mixture: documents as they were, some more than once
    assert set(ids["mixture"]) <= set(ids["personal_data"]) and len(ids["mixture"]) > len(set(ids["mixture"]))
    # packing: every id of every copy
    pieces = steps["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    copies = {i: ids["mixture"].count(i) for i in set(ids["mixture"])}
    assert {r["doc_id"] for r in pieces} == set(copies)
    assert all(r["n"] == r["t"] * copies[r["doc_id"]] for r in pieces if r["doc_id"] not in (None, 9007))


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_pipeline_of_nothing(spark, nothing):
    rows = nothing
    for name, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, SF), name)
    assert rows.count() == 0
