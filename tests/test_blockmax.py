"""BM25 by blocks against exhaustive sums."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import blockmax, bm25


@pytest.mark.parametrize("block,held,at_once", [(64, 8192, 2000), (4, 32, 3)])
def test_equal_to_exhaustive_lists(spark, monkeypatch, block, held, at_once):
    for name, value in (("BLOCK", block), ("HELD", held), ("QUESTIONS", at_once)):
        monkeypatch.setattr(blockmax, name, value)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 30))) for _ in range(300)] + ["", "w0 w0 w0"] * 10
    chunks = spark.createDataFrame([(str(i), i, x, f"m{i % 3}", "t") for i, x in enumerate(texts)], "chunk_id string, chunk_ord long, text string, vehicle_model string, doc_type string").repartition(4)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for q in range(12)] + [(20, ""), (21, None), (22, "unheard of"), (23, "w0 W0 w1")], "query_id long, question string")
    aims = asked.select("query_id", F.explode(F.array(F.lit("m0"), F.lit("m2"), F.lit(None).cast("string"))).alias("target")).withColumn("target_no", F.when(F.col("target") == "m0", 0).when(F.col("target") == "m2", 1).otherwise(2))
    all_ = bm25.scores(asked, chunks).join(chunks.select("chunk_id", "chunk_ord", "vehicle_model"), "chunk_id")
    want = {(r.query_id, r.chunk_id, r["rank"], round(r.score, 7)) for r in bm25.top_k(all_, 7, "chunk_ord", ["query_id"]).collect()}
    assert {(r.query_id, r.chunk_id, r["rank"], round(r.score, 7)) for r in blockmax.best_chunks(asked, chunks, 7).collect()} == want
    met = all_.join(aims, "query_id").where("target IS NULL OR target = vehicle_model")
    want = {(r.query_id, r.target_no, r.chunk_id, r["rank"]) for r in bm25.top_k(met, 5, "chunk_ord", ["query_id", "target_no"]).collect()}
    assert {(r.query_id, r.target_no, r.chunk_id, r["rank"]) for r in blockmax.best_chunks(asked, chunks, 5, aims).collect()} == want
    # others are counted, these alone are found
    some = blockmax.best_chunks(asked, chunks.where("doc_type = 't' AND chunk_ord < 50"), 5, statistics=chunks).collect()
    few = bm25.top_k(all_.where("chunk_ord < 50"), 5, "chunk_ord", ["query_id"]).collect()
    assert {(r.query_id, r.chunk_id, round(r.score, 7)) for r in some} == {(r.query_id, r.chunk_id, round(r.score, 7)) for r in few}
    assert blockmax.best_chunks(asked.where("false"), chunks).count() == 0 and blockmax.best_chunks(asked, chunks.where("false")).count() == 0


def test_few_pairs_are_scored():
    """Questions of common words and a rare one: most blocks are passed over unread."""
    rng = np.random.default_rng(3)
    words = [[f"c{i}" for i in range(8) if rng.random() < 0.3] * int(rng.integers(1, 3)) for _ in range(16_384)]
    for i in rng.choice(16_384, 60, replace=False):
        words[i] = [*words[i], "rare", "rare"]
    asked = blockmax.Asked([["rare", "c0", "c1", "c2"], ["rare", "c5"]], [None, None], {f"c{i}": 0.4 for i in range(8)} | {"rare": 5.5})
    best = blockmax.Best(2, 10)
    pairs = 0
    for lo in range(0, len(words), blockmax.HELD):
        some = words[lo : lo + blockmax.HELD]
        pairs += sum(1 for w in some for q in (("rare", "c0", "c1", "c2"), ("rare", "c5")) if set(w) & set(q))
        blockmax.scan(asked, best, list(range(lo, lo + len(some))), np.arange(lo, lo + len(some)), [None] * len(some), np.array([len(w) for w in some], float), some, 5.0, 1.5, 0.75)
    assert all("rare" in words[name] for rows in best.rows for _, _, name in rows) and 10 * best.scored < pairs
