"""Chunking, tables of contents, search, fusion, sessions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions.text import query_tokens, snippet, strip, tokens
from quarryline.operators import bm25, chunking, evaluation, fusion, routing, sessions, toc, vectors


def test_text(spark):
    row = spark.range(1).select(
        strip(F.lit("　 a b \n")), tokens(F.lit("Ölpreis 汽车手册, a_b!")), query_tokens(F.lit("The car is A b"), F.lit("oil，Oil, x"), F.lit("the oil")), snippet(F.lit("x" * 50 + "Needle" + "y" * 100), F.lit("needle"))
    ).first()
    assert row[0] == "a b" and row[1] == ["ölpreis", "汽车手册", "a_b"] and row[2] == ["the", "car", "is", "oil"] and row[3] == "…" + "x" * 40 + "Needle" + "y" * 80 + "…"


def test_stack_property(spark):
    """The closed form equals the stack, row by row."""
    rng = random.Random(5)
    rows = [(d, i, rng.randint(1, 4), f"t{i}") for d in range(8) for i in range(60)]
    want = {}
    stacks: dict[int, list[str]] = {}
    for d, i, level, title in rows:
        stacks[d] = stacks.get(d, [])[: level - 1] + [title]
        want[d, i] = ">".join(stacks[d])
    frame = spark.createDataFrame(rows, "source_file long, ord int, level int, title string")
    assert {(r.source_file, r.ord): r.path for r in toc.toc_paths(frame).collect()} == want
    with pytest.raises(Exception, match="deep"):
        toc.toc_paths(frame, max_depth=2).collect()


def plain_pack(blocks, least, most):
    """Greedy packing, stated row by row."""
    groups, i = [], 0
    while i < len(blocks):
        page, path, text = blocks[i]
        i += 1
        while i < len(blocks):
            p, s, x = blocks[i]
            longer = text + "\n" + x
            if s == path and len(longer) <= most:
                text, page = longer, min(page, p)
                i += 1
            elif len(text) < least:
                text, page = longer, min(page, p)
                if len(text) > most:
                    break
                i += 1
            else:
                break
        groups.append((page, path, text))
    return groups


def test_packer_property():
    rng = random.Random(6)
    for _ in range(200):
        blocks = [(rng.randint(1, 5), rng.choice("ab"), "x" * rng.randint(1, 30)) for _ in range(rng.randint(0, 25))]
        packer = chunking.SectionPacker(20, 50)
        assert packer.merge(blocks) == plain_pack(blocks, 20, 50)
        for page, path, text in packer(blocks):
            assert text.strip() and ("\n" not in text or len(text) <= 50)


def test_hierarchy(spark):
    rows = [("f", 1, 0, "第一章 总则", 20.0, True), ("f", 1, 1, "body " * 30, 10.0, False), ("f", 1, 2, "Part", 14.0, True), ("f", 2, 3, "text " * 30, 10.0, False), ("f", 2, 4, " ", 10.0, False)]
    blocks = spark.createDataFrame(rows, "source_file string, page int, block_no int, text string, font_size double, is_bold boolean")
    assert {r.block_no: r.heading_level for r in chunking.heading_levels(blocks).collect()} == {0: 1, 1: None, 2: 2, 3: None}
    got = chunking.hierarchy_chunks(blocks, 10, 200).orderBy("chunk_no").collect()
    assert [(r.page, r.section_path) for r in got] == [(1, "第一章 总则"), (2, "第一章 总则>Part")]
    assert chunking.hierarchy_chunks(blocks.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.chunker("magic")


def test_windows(spark):
    docs = spark.createDataFrame([(1, "a" * 25), (2, " "), (3, "")], "doc_id long, text string")
    got = chunking.fixed_windows(docs, 10, 3)
    assert [(r.doc_id, r.win_start, len(r.text)) for r in got.orderBy("doc_id", "win_no").collect()] == [(1, 0, 13), (1, 7, 16), (1, 17, 8)]
    pages = spark.createDataFrame([(1, 0, 1), (1, 7, 2), (1, 12, 3)], "doc_id long, start int, page int")
    assert [r.page for r in chunking.window_pages(got, pages).orderBy("win_no").collect()] == [1, 2, 1]
    assert [r.page for r in chunking.window_pages(got, pages, "asof").orderBy("win_no").collect()] == [1, 2, 3]


def test_semantic(spark):
    vec = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    rows = [(1, i, 1 + i // 2, f"{k}{i}", vec[k]) for i, k in enumerate("aaabb")] + [(2, 0, 1, "only", vec["a"])]
    para = spark.createDataFrame(rows, "doc_id long, para_no int, page int, text string, embedding array<double>")
    got = {(r.doc_id, r.group_no): (r.page, r.text) for r in chunking.semantic_groups(para).collect()}
    assert got == {(1, 0): (1, "a0\na1\na2"), (1, 1): (2, "b3\nb4"), (2, 0): (1, "only")}
    long = spark.createDataFrame([(1, "x" * 25)], "doc_id long, text string")
    assert [len(r.text) for r in chunking.enforce_size(long, 4, 10).orderBy("slice_no").collect()] == [10, 10, 9, 1]


def test_ranges(spark):
    rows = [("f", 0, 1, "A", 1), ("f", 1, 2, "B", 1), ("f", 2, 2, "C", 4), ("f", 3, 1, "D", 4), ("f", 4, 3, "E", 9)]
    entries = spark.createDataFrame(rows, "source_file string, ord int, level int, title string, page int")
    assert {r.title: r.end_page for r in toc.page_ends(entries, F.lit(20), 3).collect()} == {"A": 3, "B": 3, "C": 4, "D": 20, "E": 20}
    assert {r.title for r in toc.leaves(entries).collect()} == {"B", "C", "E"}


def test_responses(spark):
    cases = {"1, 3": [1, 3], "2、9，2": [2, 9], "无": [], "see\n 4,5 \nend": [4, 5], "2. title": [], "": [], "99": [], "７": []}
    got = spark.createDataFrame([(c,) for c in cases], "r string").select("r", toc.named_numbers(F.col("r"), 10).alias("n")).collect()
    assert {r.r: r.n for r in got} == cases


def plain_bm25(docs, query, k1=1.5, b=0.75):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: np.log(n - v + 0.5) - np.log(v + 0.5) for t, v in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    return {i: sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in query) for i, d in docs.items()}


def test_bm25(spark):
    rng = random.Random(2)
    docs = {str(i): rng.choices("abcdefgh", k=rng.randint(1, 12)) for i in range(40)}
    query = ["a", "b", "b", "z"]
    chunks = spark.createDataFrame([(i, int(i), " ".join(d), f"m{int(i) % 2}", "t") for i, d in docs.items()], "chunk_id string, chunk_ord long, text string, vehicle_model string, doc_type string")
    asked = spark.createDataFrame([(1, " ".join(query))], "query_id long, question string")
    want = plain_bm25(docs, query)
    got = bm25.search(asked, chunks, 40, pad_zero=True).orderBy("rank").collect()
    assert [r.chunk_id for r in got if r.score > 0] == [i for i in sorted(docs, key=lambda i: (-round(want[i], 9), int(i))) if want[i] > 0]
    assert all(abs(r.score - want[r.chunk_id]) < 1e-9 for r in got)
    assert {r.chunk_id for r in bm25.search(asked, chunks, 40, models=["m1"]).collect()} <= {str(i) for i in range(1, 40, 2)}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{i:03}", v.tolist(), f"m{i % 3}", "t") for i, v in enumerate(rng.normal(size=(90, 8)))]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, vehicle_model string, doc_type string").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5, 8)))], "query_id long, embedding array<float>")
    score = {(q[0], c[0]): float(np.dot(np.float32(q[1]).astype(float), np.float32(c[1]).astype(float))) for q in asked.collect() for c in rows}
    for q in range(5):
        best = sorted((c[0] for c in rows), key=lambda c: (-round(score[q, c], 9), c))
        got = {(r.rank, r.chunk_id) for r in vectors.search(asked, corpus, 4).where(f"query_id = {q}").collect()}
        assert got == {(i + 1, c) for i, c in enumerate(best[:4])}
        late = [c for c in best[:12] if int(c) % 3 == 1][:4]
        assert [r.chunk_id for r in vectors.search(asked, corpus, 4, models=["m1"]).where(f"query_id = {q}").orderBy("rank").collect()] == late
        early = [c for c in best if int(c) % 3 == 1][:4]
        assert [r.chunk_id for r in vectors.search(asked, corpus, 4, models=["m1"], prefilter=True).where(f"query_id = {q}").orderBy("rank").collect()] == early
    assert vectors.search(asked.limit(0), corpus, 4).count() == 0


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(x)], "query_id long, chunk_id string, rank int") for x in ("abc", "cbd")]
    got = fusion.reciprocal_rank_fusion(lists, [0.5, 0.5], 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c", "b", "a", "d"]
    assert abs(got[0].score - (0.5 / 63 + 0.5 / 61)) < 1e-12
    sections = spark.createDataFrame(got).withColumn("section", F.when(F.col("chunk_id") == "d", "Tyres").otherwise("x"))
    boosted = fusion.section_boost(sections, F.col("section"), F.array(F.lit("tyre"), F.lit("x")), 3.0)
    assert boosted.orderBy("rank").first().chunk_id == "d"
    paths = [spark.createDataFrame([(1, c, 1.0, i + 1) for i, c in enumerate(x)], "query_id long, chunk_id string, score double, rank int") for x in ("ab", "bcde")]
    assert [r.chunk_id for r in fusion.merge_paths(paths, 4).orderBy("rank").collect()] == ["a", "b", "c", "d"]
    assert [r.chunk_id for r in fusion.merge_paths(paths, 2).orderBy("rank").collect()] == ["a", "b", "c"]
    rows = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.5, None), ("c", 0.5, 0.9)], "chunk_id string, score double, similarity double")
    kept, dropped = fusion.similarity_floor(rows, 0.2)
    assert {r.chunk_id: r.score for r in kept.collect()} == {"b": 0.5, "c": 0.9} and [r.chunk_id for r in dropped.collect()] == ["a"]


def test_metrics(spark):
    cases = spark.createDataFrame([("1", ["a", "b"]), ("2", []), ("3", None)], "case_id string, expected_chunk_ids array<string>")
    found = spark.createDataFrame([("2", "z"), ("1", "ignored")], "case_id string, chunk_id string")
    retrieved = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "q"), ("2", "q")], "case_id string, chunk_id string")
    got = evaluation.case_metrics(cases, retrieved, evaluation.expected_ids(cases, found))
    assert {r.case_id: (r.n_expected, r.n_matched, r.hit, r.recall) for r in got.collect()} == {"1": (2, 1, 1, 0.5), "2": (1, 0, 0, 0.0), "3": (0, 0, None, None)}
    assert tuple(evaluation.summary(got).first()) == (3, 2, 0.5, 0.25)


def test_sessions(spark):
    said = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "alone"), (1, 4, "user", "q2"), (1, 5, "assistant", "a2"), (1, 6, "user", "q3"), (1, 7, "assistant", "a3")]
    turns = sessions.turns_of(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    got = {r.turn: (r.last_question, r.recent, r.earlier) for r in sessions.history(turns, 2).collect()}
    assert got == {1: (None, [], []), 4: ("q1", ["q1"], []), 6: ("q2", ["q1", "q2"], ["q1"])}
    rng = random.Random(1)
    uses = [(1, t, p, rng.choice("abcdef")) for t in (1, 4, 6) for p in range(4)]
    cache, want = [], {}
    for t in (1, 4, 6):
        want[t] = list(cache)
        for _, u, _, c in uses:
            if u == t:
                cache = [x for x in cache if x != c] + [c]
        cache = cache[-3:]
    frame = sessions.cache_before(turns, spark.createDataFrame(uses, "session_id long, turn long, pos int, chunk_id string"), 3)
    rows = sorted((r.turn, r.cache_pos, r.chunk_id) for r in frame.collect())
    assert {t: [c for u, _, c in rows if u == t] for t in want} == want
    found = turns.withColumn("found", F.when(F.col("turn") == 4, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")))
    assert {r.turn: (r.active, r.needs_clarification) for r in routing.sticky(found).collect()} == {1: (None, True), 4: (["m"], False), 6: (["m"], False)}


def test_lookup_in_blocks(spark, monkeypatch):
    """More texts than one block holds are all looked up."""
    monkeypatch.setattr(evaluation, "NEEDLES", 4)
    needles = [(i, f"Word{i} ") for i in range(23)] + [(30, "WORD3 "), (31, " "), (32, None)]
    texts = [(str(c), "s", " ".join(f"word{i} x" for i in range(c, 23, c + 2))) for c in range(6)]
    got = evaluation.text_lookup(spark.createDataFrame(needles, "case_id long, needle string"), spark.createDataFrame(texts, "chunk_id string, section_path string, text string")).collect()
    want = sorted((i, c) for i, n in needles if n and n.strip() for c, _, text in texts if n.lower() in text.lower())
    assert sorted((r.case_id, r.chunk_id) for r in got) == want and len(want) > 23
