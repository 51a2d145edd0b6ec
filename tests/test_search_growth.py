"""What a search over a growing table reads, carries and adds up."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions.text import SPACE, SPACES, strip
from quarryline.operators import blockmax, bm25, chunking, evaluation


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_texts_are_looked_up_without_rows_of_words(spark):
    """a row with the whole text was made for each of its words."""
    chunks = spark.createDataFrame([("1", "s", "The alpha beta gamma, end"), ("2", "s", "ALPHA BETA GAMMA"), ("3", "s", "alpha gamma"), ("4", "s", None)], "chunk_id string, section_path string, text string")
    needles = spark.createDataFrame([(1, "alpha beta gamma"), (2, "Alpha"), (3, " "), (4, None), (5, "pha bet"), (5, "a gam")], "case_id long, needle string")
    found = evaluation.text_lookup(needles, chunks)
    assert "Generate" not in _plan(found)
    assert sorted((r.case_id, r.chunk_id) for r in found.collect()) == [(1, "1"), (1, "2"), (2, "1"), (2, "2"), (2, "3"), (5, "1"), (5, "1"), (5, "2"), (5, "2"), (5, "3")]


def test_windows_are_made_before_rows_part(spark):
    """each window's row carried all the text's cuts, and was stripped twice by a regular expression."""
    docs = spark.createDataFrame([(1, " \n" + "ab  " * 40 + "　"), (2, " " * 25), (3, "")], "doc_id long, text string")
    rows = chunking.fixed_windows(docs, 10, 3)
    plan = _plan(rows)
    assert "Generate posexplode(transform(" in plan and plan.count("trim(") == 1
    text = docs.first().text
    assert {r.win_no: r.text for r in rows.collect()} == {a // 10: text[max(0, a - 3) : a + 13].strip() for a in range(0, len(text), 10)}


def test_strip_takes_the_whole_class(spark):
    rng = random.Random(4)
    letters = SPACES + "ab​᠎\x08é日" * 4
    rows = spark.createDataFrame([("".join(rng.choices(letters, k=rng.randint(0, 12))),) for _ in range(500)] + [(None,)], "s string")
    assert rows.where(~strip(F.col("s")).eqNullSafe(F.regexp_replace("s", f"^{SPACE}+|{SPACE}+$", ""))).count() == 0


@pytest.mark.parametrize("counted,terms", [(6, 200_000), (500_000, 200_000), (500_000, 3)])
def test_a_search_keeps_the_postings_it_asks_for(spark, monkeypatch, counted, terms):
    """An index of all terms was written for one search; counts are still those of all terms."""
    monkeypatch.setattr(bm25, "COUNTED", counted)
    monkeypatch.setattr(bm25, "AT_ONCE", 7)
    monkeypatch.setattr(blockmax, "TERMS", terms)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    chunks = spark.createDataFrame([(str(i), i, None if i == 5 else " ".join(rng.choices(words, k=rng.randint(0, 20))), "m", "t") for i in range(90)], "chunk_id string, chunk_ord long, text string, vehicle_model string, doc_type string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words[:9], k=4))) for q in range(6)], "query_id long, question string")
    key = lambda df: {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in df.collect()}
    sums = bm25.scores(asked, chunks).join(chunks.select("chunk_id", "chunk_ord"), "chunk_id")
    want = key(bm25.top_k(sums, 5, "chunk_ord", ["query_id"]))
    if terms > 9:

        def never(*a, **k):
            raise AssertionError("all terms' postings are kept")

        monkeypatch.setattr(bm25, "indexed", never)
    assert key(bm25.search(asked, chunks, 5)) == want and want


@pytest.mark.parametrize("limits", [{}, {"PARTS": 40, "PAIRS": 60, "BLOCK": 3}])
def test_scores_of_all_questions_at_once(monkeypatch, limits):
    """Blocks were gone through question by question. Weights below 0 and of 0, groups, ties."""
    for name, value in limits.items():
        monkeypatch.setattr(blockmax, name, value)
    rng = random.Random(7)
    for _ in range(30):
        idf = {f"t{i}": rng.choice([-0.4, 0.0, 0.3, 0.3, 2.0, 5.0]) for i in range(12)}
        questions = [rng.choices([*idf, "unknown"], k=rng.randint(0, 6)) for _ in range(9)]
        aims = [rng.choice([None, "a", "b", "none"]) for _ in questions]
        asked, best = blockmax.Asked(questions, aims, idf), blockmax.Best(9, 4)
        texts = [rng.choices([*idf, "other"], k=rng.randint(0, 9)) for _ in range(120)]
        kinds = [rng.choice(["a", "b", None]) for _ in texts]
        dl = np.array([len(x) for x in texts], float)
        for lo in range(0, 120, 50):
            own = slice(lo, min(120, lo + 50))
            names = list(range(120))[own]
            blockmax.scan(asked, best, names, np.array(names), kinds[own], dl[own], texts[own], 5.0, 1.5, 0.75)
        for q, (terms, aim) in enumerate(zip(questions, aims, strict=True)):
            rows = []
            for i, text in enumerate(texts):
                if set(terms) & set(text) & set(idf) and aim in (None, kinds[i]):
                    parts = [idf[t] * text.count(t) * 2.5 / (text.count(t) + 1.5 * (0.25 + 0.75 * len(text) / 5.0)) for t in terms if t in idf]
                    rows.append((-round(sum(parts), 9) + 0.0, i))
            assert [(-round(s, 9) + 0.0, i) for s, i, _ in best.rows[q]] == sorted(rows)[:4]
