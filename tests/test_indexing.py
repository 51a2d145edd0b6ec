"""The written index, lookups by the rarest word, windows in one pass, splits by bins, sidecars, merging with caps by query."""

from __future__ import annotations

import hashlib
import random

import pytest

from quarryline.operators import bm25, chunking, corpus_gen, evaluation, export, fusion
from quarryline.sources import corpus


def test_index(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    chunks = spark.createDataFrame([(str(i), i, " ".join(rng.choices(words, k=rng.randint(0, 30))), "m", "t") for i in range(60)], "chunk_id string, chunk_ord long, text string, vehicle_model string, doc_type string")
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4)) + " nowhere") for q in range(6)], "query_id long, question string")
    bm25.write_index(chunks, f"{tmp_path}/index")
    key = lambda df: sorted((r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in df.collect())
    plain = key(bm25.search(asked, chunks, 7))
    assert plain and key(bm25.search(asked, chunks, 7, index=bm25.read_index(spark, f"{tmp_path}/index"))) == plain


def test_index_in_segments(spark, tmp_path):
    """An index and what came later equal one built anew; another corpus, or none, raises an error."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 20)))
    now = {str(i): text() for i in range(60)}
    frame = lambda d: spark.createDataFrame([(c, int(c), x, "m", "t") for c, x in d.items()], "chunk_id string, chunk_ord long, text string, vehicle_model string, doc_type string")
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4))) for q in range(6)], "query_id long, question string")
    key = lambda df: sorted((r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in df.collect())
    path = f"{tmp_path}/grown"
    with pytest.raises(ValueError):
        bm25.read_index(spark, path)
    bm25.write_index(frame(now), path)
    with pytest.raises(ValueError):
        bm25.write_index(frame(now), path)
    for step in range(3):
        gone = rng.sample(sorted(now), 7)
        more = {str(100 * (step + 1) + i): text() for i in range(5)} | {c: text() for c in gone[:3]}  # three are changed
        now = {c: x for c, x in now.items() if c not in gone} | more
        bm25.update_index(spark, path, frame(more), spark.createDataFrame([(c,) for c in gone], "chunk_id string"))
        rows = frame(now)
        got = bm25.read_index(spark, path, rows)
        assert key(bm25.search(asked, rows, 7, index=got)) == key(bm25.search(asked, rows, 7))
        assert {(r.term, r.df) for r in got.terms.collect()} == {(r.term, r.df) for r in bm25.term_statistics(rows).collect()}
    with pytest.raises(ValueError):
        bm25.read_index(spark, path, frame(now | {"0": "other"}))
    with pytest.raises(ValueError):
        bm25.update_index(spark, path, removed=spark.createDataFrame([("none",)], "chunk_id string"))
    with pytest.raises(ValueError):
        bm25.update_index(spark, path, added=frame({next(iter(now)): "again"}))
    flat = bm25.scores(asked, bm25.read_index(spark, path), epsilon=0.0).collect()  # the index doesn't fix it
    assert sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in flat) == sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in bm25.scores(asked, rows, epsilon=0.0).collect())


@pytest.mark.parametrize("few", [1, 10_000])
def test_lookup(spark, monkeypatch, few):
    """Against every pair; texts of one, two and many words, of repeated ids, in blocks or by shuffle."""
    monkeypatch.setattr(evaluation, "NEEDLES", few)
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "delta-x", "é", "日本"]
    texts = [(str(i), "s", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(50)]
    needles = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4]))).swapcase()) for i in range(30)] + [(0, "alpha beta gamma"), (0, "alpha beta gamma"), (31, " "), (32, "alpha unseen beta"), (33, "lta")]
    got = evaluation.text_lookup(spark.createDataFrame(needles, "case_id long, needle string"), spark.createDataFrame(texts, "chunk_id string, section_path string, text string")).collect()
    want = sorted((n, c) for n, x in needles for c, _, t in texts if x.strip() and x.lower() in t.lower())
    assert sorted((r.case_id, r.chunk_id) for r in got) == want and want


def test_windows(spark):
    text = "".join(random.Random(3).choices("ab é日\n ", k=997))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 20)], "doc_id long, text string")
    for size, overlap in ((100, 30), (7, 7), (1000, 0)):
        got = {(r.doc_id, r.win_start): r.text for r in chunking.fixed_windows(docs, size, overlap).collect()}
        want = {(i, max(0, a - overlap)): t[max(0, a - overlap) : a + size + overlap].strip() for i, t in ((1, text), (4, "x" * 20)) for a in range(0, len(t), size)}
        assert got == {k: v for k, v in want.items() if v}
    with pytest.raises(ValueError):
        chunking.fixed_windows(docs, 5, 6)


def test_split(spark, monkeypatch):
    monkeypatch.setattr(export, "PER_BIN", 10)
    rows = spark.range(300).selectExpr("concat('Q', id) AS qid", "concat('t', least(id % 7, 2)) AS task_type", "id AS _other")
    got = {r.qid: r.split for r in export.split(rows, 0.8, 5).collect()}
    for task in ("t0", "t1", "t2"):
        own = sorted((hashlib.sha256(f"5|{r.qid}".encode()).hexdigest(), r.qid) for r in rows.where(f"task_type = '{task}'").collect())
        assert [got[q] for _, q in own] == ["train"] * round(len(own) * 0.8) + ["dev"] * (len(own) - round(len(own) * 0.8))


def test_gate(spark):
    rows = spark.createDataFrame([(1, 1, 0.4, 0.4, 1, 1), (2, 6, 0.9, 0.5, 6, 3), (3, 6, 0.9, 0.5, 5, 3), (4, 0, None, None, None, 0), (5, 2, 0.5, 0.4, 2, 1)], "qid int, retrieved long, max_score double, seed_score double, seed_rank int, same_section_count long")
    from pyspark.sql import functions as F

    say = lambda **k: [r.v for r in rows.select("qid", corpus_gen.gate(F.lit("full"), F.lit(False), **k).alias("v")).orderBy("qid").collect()]
    assert say() == ["single_chunk_full", "seed_not_returned", "ok", "seed_not_returned", "ok"]
    assert say(min_retrieved=3) == ["single_chunk_full", "seed_not_returned", "ok", "seed_not_returned", "too_few_chunks"]


def test_caps(spark):
    ranked = spark.createDataFrame([(q, f"c{i}", 1.0, i) for q in (1, 2) for i in range(1, 6)], "query_id long, chunk_id string, score double, rank int")
    other = spark.createDataFrame([(q, f"d{i}", 1.0, i) for q in (1, 2) for i in range(1, 6)], "query_id long, chunk_id string, score double, rank int")
    caps = spark.createDataFrame([(1, 7), (2, 3)], "query_id long, cap int")
    got = fusion.merge_paths([ranked, other], caps).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 7, 2: 6}


def test_sidecars(spark, tmp_path):
    bad = spark.createDataFrame([("Q1", "m", "s", "t", "c", "p", "gate", "low_score", "", None)], corpus.REJECTED)
    corpus.write_rejected(bad, f"{tmp_path}/rejected")
    assert spark.read.schema(corpus.REJECTED).json(f"{tmp_path}/rejected").first().question == ""
    entries = spark.createDataFrame([("f", "m", 0, 1, "Title", 3, "Title")], corpus.TOC)
    corpus.write_toc(entries, f"{tmp_path}/toc")
    assert corpus.read_toc(spark, f"{tmp_path}/toc").collect() == entries.collect()
