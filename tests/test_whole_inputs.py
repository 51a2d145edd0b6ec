"""Queries over whole texts and whole questions."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quarryline.jobs import registry

Q = registry.QUERIES


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Long texts whose leak, number, alias and named path come last; a question whose only telling words do."""
    path = str(tmp_path_factory.mktemp("sf"))
    long = "word " * 2000
    texts = ["Head\n" + long + "x", "Head\n" + long + " [12] 77 bar stupid que Head", "Head\n" + long + "y"]
    docs = spark.createDataFrame([(i, x, "en", "src0") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text")).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "zz " * 40 + "head")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(spark, sf, name):
    return {r[0]: r[1] for r in Q[name](spark, sf).collect()}


def test_answers(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: hashlib.md5(x[30:].replace("[12]", "").strip().encode()).hexdigest() for i, x in texts.items()}
    assert rows(spark, sf, "leak_strip") == want
    assert rows(spark, sf, "ungrounded_numbers") == {0: "", 1: "77bar", 2: ""}
    assert rows(spark, sf, "quality_gate") == {0: "field_incomplete", 1: "ungrounded_number", 2: "length_out_of_bounds"}  # the question of 0 is blank


def test_routes_and_paths(spark, sf):
    assert rows(spark, sf, "route_models")[1] == "m5" and rows(spark, sf, "route_models")[0] == ""
    assert {(r.response_id, r.path) for r in Q["response_paths"](spark, sf).collect()} >= {(i, "Head") for i in range(3)}


def test_questions(spark, sf):
    assert {r.query_id for r in Q["bookmark_catalogue"](spark, sf).collect()} == {0}
    best = Q["bookmark_scores"](spark, sf).where("position = 1").first()
    assert best.score > 2  # 'head' lies past character 60
    assert Q["bookmark_chunks"](spark, sf).count() > 0
    picked = Q["bookmark_evidence"](spark, sf).collect()
    assert sorted(r.position for r in picked) == [1, 2, 3] and {r.picked_by for r in picked} == {"whole catalogue"}  # the call fails


def sessions_of(spark, path, n):
    """Tables of n documents and vectors, and sessions of four turns."""
    spark.range(n).selectExpr("id AS doc_id", "concat('The part', id, ' is') AS text", "'en' AS lang", "'src0' AS source").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.range(n).selectExpr("id AS vec_id", "array(1.0f, cast(id AS float)) AS embedding").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    spark.range(n).where("id % 2 = 0").selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").coalesce(1).write.parquet(f"{path}/labels.parquet")
    said = [(c, k, "user" if k % 2 == 0 else "assistant", "x") for c in range(20) for k in range(8)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_sessions_reach_all_rows(spark, tmp_path):
    path = sessions_of(spark, tmp_path, 300)
    used = {(c * 7919 + k * 104729 + p * 1299709) % 300 for c in range(20) for k in (0, 2, 4) for p in range(4)}  # the last turn's aren't cached yet
    cached = {int(r.chunk_id) for r in Q["lru_cache"](spark, path).collect()}
    assert cached <= used and len(cached) > 100 and max(cached) > 250
    near = {int(r.chunk_id) for r in Q["cache_reuse"](spark, path).collect()}
    assert near <= cached and max(near) > 250
    named = {int(h.split(">")[1][4:]) for r in Q["section_hints"](spark, path).collect() for h in r.hints.split("|")}
    assert named <= cached and max(named) > 250


def test_report_has_every_row(spark, tmp_path):
    path = sessions_of(spark, tmp_path, 300)
    n = {(r.dimension, r.value): r.n for r in Q["generation_report"](spark, path).collect()}
    accepted, rejected = (sum(v for (d, _), v in n.items() if d == x) for x in ("accept_tier", "reject_reason"))
    assert accepted + rejected == 300 and n["pass_rate", "all"] == accepted > 0 and rejected > 0
