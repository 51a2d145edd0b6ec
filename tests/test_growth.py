"""What grows with the input: work that was quadratic, or held whole, at larger tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quarryline.operators import blockmax, bm25, chunking, completion, matching


def _corpus(spark, n=200):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(str(i), i, " ".join(rng.choices(words, k=rng.randint(0, 25))), "m", "ab"[i % 2]) for i in range(n)], "chunk_id string, chunk_ord long, text string, vehicle_model string, doc_type string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4))) for q in range(8)] + [(9, "w3 unheard"), (10, "unheard")], "query_id long, question string")
    return chunks, asked


@pytest.mark.parametrize("indexed,pad_zero", [(True, False), (False, True), (True, True)])
def test_searches_do_not_sum_all_pairs(spark, tmp_path, monkeypatch, indexed, pad_zero):
    """A search over an index, and one whose lists are filled up, go by blocks; lists and unrounded scores as from all sums."""
    chunks, asked = _corpus(spark)
    sums = bm25.scores(asked, chunks).join(chunks.where("doc_type = 'a'").select("chunk_id", "chunk_ord"), "chunk_id").collect()
    some = sorted((r.chunk_ord, r.chunk_id) for r in chunks.where("doc_type = 'a'").collect())
    want = {}
    for q in (r.query_id for r in asked.collect()):
        rows = {r.chunk_id: (r.score, r.chunk_ord) for r in sums if r.query_id == q}
        if pad_zero:
            rows |= {c: (0.0, o) for o, c in some[:14] if c not in rows}
        for rank, (c, (score, _)) in enumerate(sorted(rows.items(), key=lambda x: (-round(x[1][0], 9), x[1][1]))[:7], 1):
            want[q, rank] = (c, score)
    index = None
    if indexed:
        bm25.write_index(chunks, f"{tmp_path}/index")
        index = bm25.read_index(spark, f"{tmp_path}/index", chunks)

    def never(*a, **k):
        raise AssertionError("all pairs are summed")

    monkeypatch.setattr(bm25, "scores", never)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in bm25.search(asked, chunks, 7, doc_types=["a"], pad_zero=pad_zero, index=index).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_scores_are_not_rounded():
    """Rounded to nine digits and then to six, a score near a half came out one off."""
    best = blockmax.Best(1, 2)
    best.add(0, np.array([1.0000004999999, 0.5]), np.array([0, 1]), ["a", "b"].__getitem__)
    assert [round(r[0], 6) for r in best.rows[0]] == [1.0, 0.5]


def _dealt(df, column) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({column}#")


def test_documents_are_packed_in_one_pass(spark):
    """no group of rows is made for each document, blocks are dealt once, and a group is given on before the document ends."""
    blocks = spark.createDataFrame([(f"d{i % 7}", 1 + i // 20, i, f"text {i} " * (1 + i % 9), 10.0 + 4 * (i % 11 == 0), i % 13 == 0) for i in range(150)], "source_file string, page int, block_no int, text string, font_size double, is_bold boolean")
    made = chunking.hierarchy_chunks(blocks, 40, 120)
    assert _dealt(made, "source_file") == 1 and "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    pack = chunking.SectionPacker(40, 120)
    body = chunking.section_paths(chunking.heading_levels(blocks)).collect()
    want = {(d, n, *c) for d in {r.source_file for r in body} for n, c in enumerate(pack([(r.page, r.section_path, r.text) for r in sorted(body, key=lambda r: r.block_no) if r.source_file == d]))}
    assert {tuple(r) for r in made.collect()} == want and want
    endless = ((1, "p", "x" * 50) for _ in iter(int, 1))
    assert len(next(pack.chunks(endless))[2]) == 101


def test_vectors_do_not_carry_texts(spark):
    """texts and vectors meet in one shuffle by document; what has no vector is left out, as by a join."""
    rng = random.Random(3)
    rows = [(d, n, n // 3, f"t{d}.{n}", [rng.uniform(-1, 1) for _ in range(4)]) for d in range(4) for n in range(12)]
    para = spark.createDataFrame(rows, "doc_id long, para_no int, page int, text string, embedding array<double>")
    some = para.where("(doc_id + para_no) % 5 > 0")
    apart = chunking.semantic_groups(para.drop("embedding"), vectors=some.select("doc_id", "para_no", "embedding"))
    assert _dealt(apart, "doc_id") == 1
    key = lambda df: sorted((r.doc_id, r.group_no, r.page, r.text) for r in df.collect())
    assert key(apart) == key(chunking.semantic_groups(some)) and len(key(apart)) > 4


def test_what_a_task_remembers_of_contents_is_bounded(monkeypatch):
    """by bytes, however long the lines are; scores don't depend on it."""
    monkeypatch.setattr(matching, "REMEMBERED", 20_000)
    words = ["alpha", "beta", "ta", "alphabet", "a>b"]
    known = matching.Words(words)
    for i in range(300):
        row = np.zeros(len(words), np.float32)
        known.count(row, f"Alpha{i} {'x' * 400}>Ta>bet", "bet a>b")
        assert row.tolist() == [3, 4, 3, 2, 1]
        assert sum(2 * len(p) for p in known.known) <= 20_000


def test_prompts_stay_in_arrow(spark):
    """a task has a few prompts in Python at once; rows go back as they came, without a data frame of all."""
    rows = spark.createDataFrame([(i, None if i == 7 else f"p{i}", [i]) for i in range(600)], "id long, prompt string, other array<long>").coalesce(1)
    made = completion.complete(rows, lambda: lambda prompt: prompt.upper(), retries=0)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.response, r.error is None, r.attempts, r.other) for r in made.collect()}
    assert got == {i: (None if i == 7 else f"P{i}", i != 7, 1, [i]) for i in range(600)}


def test_a_run_that_goes_on_reads_the_index_there_is(spark, tmp_path):
    """an index is found again, and its chunks' facts are joined once, not for each search."""
    chunks, asked = _corpus(spark, 60)
    path = f"{tmp_path}/index"
    assert not bm25.exists(spark, path)
    bm25.write_index(chunks, path)
    assert bm25.exists(spark, path)
    index = bm25.read_index(spark, path, chunks)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    whole = bm25.search(asked, chunks, 5, index=bm25.with_facts(index, chunks))
    assert key(whole) == key(bm25.search(asked, chunks, 5, index=index)) and "group" in bm25.with_facts(index, chunks).rows.columns
