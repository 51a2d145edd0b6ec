"""How often a search's steps run, and on what."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.functions.words import Words, word_characters
from quarryline.jobs import registry
from quarryline.operators import blockmax, bm25

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_those_of_the_expression(spark):
    """Words were cut in the JVM and handed to Python one string each."""
    rng = random.Random(3)
    letters = "aZ09_ \n.,-éßİǅЖ日本語١Ⅷ½𐐀𝔘😀́‍ \x00" + "".join(chr(c) for c in (0x7F, 0x80, 0x7FF, 0x800, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x31350, 0x10FFFF))
    texts = [None, "", "a", "é", "日", "😀", "_", " a"] + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(300)]
    texts += ["".join(chr(c) for c in rng.choices([*range(0xD800), *range(0xE000, 0x110000)], k=200)) for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, s string").select("n", F.lower("s").alias("s"), tokens(F.col("s")).alias("want")).orderBy("n").collect()
    column = pa.array([r.s for r in rows], pa.string())
    cut = Words(word_characters(spark))
    for lo, hi in ((0, len(rows)), (7, 20), (0, 2), (5, 5)):
        words, size = cut(column.slice(lo, hi - lo))
        ends = np.cumsum(size)
        assert [words.slice(e - n, n).to_pylist() for e, n in zip(ends.tolist(), size.tolist(), strict=True)] == [r.want or [] for r in rows[lo:hi]] and ends[-1:].sum() == len(words)
    chunks = spark.createDataFrame([("1", "a b")], "chunk_id string, text string")
    assert all("regexp_extract_all" not in _plan(df) for df in (bm25.indexed(chunks), bm25.indexed_for(chunks, ["a"])))


def test_parts_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "abc", "x" * 50, "", "é", "a", "b"])], ["words"])
    assert [p.num_rows for p in bm25._parts(batch, "words", 3, 5)] == [3, 1, 3, 1]


@pytest.mark.parametrize("few", [True, False])
def test_weights_of_some_terms(spark, few):
    """Counts of all terms were written and gone through twice for the weights of a few."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(str(i), " ".join(rng.choices(words, [1 / (i + 1) for i in range(30)], k=20))) for i in range(40)], "chunk_id string, text string")
    said = spark.createDataFrame([("w0",), ("w1",), ("w9",), ("nowhere",)], "term string")
    want = {r.term: round(r.idf, 9) for r in bm25.term_statistics(chunks).where("term IN ('w0', 'w1', 'w9')").collect()}
    index = bm25.index_of(chunks, wanted=["nowhere", "w0", "w1", "w9"])
    assert "Aggregate" in _plan(index.terms)
    assert {r.term: round(r.idf, 9) for r in index.weights_of(said, few=few).collect()} == want and want["w0"] < want["w9"]


@pytest.mark.parametrize("name,steps", [("merged_evidence", 0), ("stage_counts", 1), ("hybrid_boosted", 0)])
def test_searches_run_once(spark, name, steps):
    """both sides of the floor ran both searches; F18: two stages ran the vectors' search; F20: chunks were shuffled to lists of unknown length."""
    assert _plan(registry.QUERIES[name](spark, SMALL)).count("MapInArrow") == steps


def test_questions_about_a_group_meet_its_chunks(monkeypatch):
    """each question about a group was added up over the chunks of all groups."""
    rng = random.Random(9)
    words = [f"t{i}" for i in range(10)]
    texts, kinds = [rng.choices(words, k=5) for _ in range(200)], [f"g{i % 4}" for i in range(200)]
    aims = [f"g{i % 4}" for i in range(20)]
    asked, best, met, plain = blockmax.Asked([rng.choices(words, k=3) for _ in aims], aims, dict.fromkeys(words, 1.0)), blockmax.Best(20, 3), [], blockmax._block

    def counted(some, best, names, *rest):
        met.append(len(some.terms) * len(names))
        plain(some, best, names, *rest)

    monkeypatch.setattr(blockmax, "_block", counted)
    blockmax.scan(asked, best, list(range(200)), np.arange(200), kinds, np.full(200, 5.0), texts, 5.0, 1.5, 0.75)
    assert sum(met) <= 20 * 200 // 4
    assert all(kinds[i] == aim for aim, rows in zip(aims, best.rows, strict=True) for _, i, _ in rows) and any(best.rows)
