"""Entries, sessions and vectors by the scalable operators against plain loops."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarryline.operators import matching, retrieval, routing, sessions, toc, vectors


def plain_score(words, path, title):
    parts = [p for p in path.lower().split(">") if p]
    hay = f"{path}>{title}".lower()
    return sum((w in hay) + 2 * sum(1 for p in parts if p in w or w in p) for w in words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    alphabet = ["oil", "tyre", "ab", "abc", "一二", "Door", "x" * 30, "the lamp", "a"]
    entries = []
    for i in range(200):
        path = ">".join(rng.choice(alphabet) + rng.choice(["", "s", " of abc", "ZZ"]) for _ in range(rng.randint(1, 4)))
        title = path.split(">")[-1] if rng.random() < 0.8 else rng.choice(["other>way", "abcd"])
        entries.append((f"m{i % 3}", path, title, {"o": i % 50, "f": f"f{i % 7}"}, rng.randint(1, 4), rng.randint(1, 9)))
    asked = []
    for q in range(30):
        words = [rng.choice(["oil", "abcd", "a", "tyres", "y" + "x" * 40, "x" * 25, "two 一二三", "s>ab", "none", "door"]) for _ in range(rng.randint(0, 5))]
        asked.append((q, f"m{q % 4}", list(dict.fromkeys(words)), f"question Door {q}" if q % 2 else "question"))
    asked.append((99, None, ["oil"], "q"))
    frame = spark.createDataFrame(entries, "vehicle_model string, path string, title string, ord struct<o:int,f:string>, level int, page int").repartition(4)
    return entries, asked, frame, spark.createDataFrame(asked, "query_id long, vehicle_model string, words array<string>, question string")


@pytest.mark.parametrize("at_once", [2000, 7])
def test_matched_entries(tables, monkeypatch, at_once):
    entries, asked, frame, questions = tables
    monkeypatch.setattr(matching, "QUESTIONS", at_once)
    want = set()
    for q, model, words, question in asked:
        scored = []
        for m, path, title, order, level, page in entries:
            if m == model and words:
                s = round(plain_score(words, path, title) + 0.01 * len(path) - 3 * ("Door" in path and "Door" not in question), 6)
                if s > 0:
                    scored.append((-s, order["o"], order["f"], path))
        want |= {(q, i, path, -s) for i, (s, _, _, path) in enumerate(sorted(scored)[:3], 1)}
    got = {(r.query_id, r.position, r.path, r.score) for r in matching.matched_entries(questions, frame, 3, ["Door"]).collect()}
    assert got == want and len(got) > 50


def test_catalogue(tables):
    entries, asked, frame, questions = tables
    want = set()
    for q, model, words, _ in asked:
        own = [(plain_score(words, p, t), p, o, level, page) for m, p, t, o, level, page in entries if m == model]
        if words and any(s for s, *_ in own):
            order = sorted((-round(s + 0.01 * len(p), 6), o["o"], o["f"], p) for s, p, o, _, _ in own if s)
        elif words:
            order = sorted((-level, page, o["o"], o["f"], p) for _, p, o, level, page in own)
        else:
            order = sorted((o["o"], o["f"], p) for _, p, o, _, _ in own)
        want |= {(q, i, x[-1]) for i, x in enumerate(order[:20], 1)}
    assert {(r.query_id, r.position, r.path) for r in matching.catalogue(questions, frame, 20).collect()} == want


def test_chunks_meet_entries_by_bins(spark):
    """Ranges of very different lengths; each pair once."""
    rng = random.Random(8)
    chunks = [(f"c{i}", i, f"m{i % 2}", rng.randint(1, 3000), rng.choice(["A>B", "C", ""])) for i in range(400)]
    entries = []
    for i in range(40):
        a = rng.randint(1, 3000)
        entries.append((i % 5, i, f"m{i % 2}", "A>B", "B", a, a + rng.choice([0, 1, 15, 16, 17, 400, 3000])))
    entries += [(q, 50 + q, "m0", "A>B", " B ", 10, 900) for q in range(5)]  # one entry of several questions
    got = toc.chunks_of_entries(
        spark.createDataFrame(entries, "query_id long, position int, vehicle_model string, path string, title string, page int, end_page int"),
        spark.createDataFrame(chunks, "chunk_id string, chunk_ord long, vehicle_model string, page int, section_path string"),
        3,
        "vehicle_model",
    )
    want = {}
    for q, pos, model, _, _, a, b in entries:
        met = sorted((0 if s == "A>B" else 1, page, order, c) for c, order, m, page, s in chunks if m == model and a <= page <= b)[:3]
        for n, (*_, c) in enumerate(met):
            want[q, c] = min(want.get((q, c), (10**9, 0)), (pos, n))
    order: dict = {}
    for (q, c), place in sorted(want.items(), key=lambda kv: (kv[0][0], kv[1])):
        order.setdefault(q, []).append(c)
    assert {(r.query_id, r.position, r.chunk_id) for r in got.collect()} == {(q, i, c) for q, cs in order.items() for i, c in enumerate(cs, 1)}


@pytest.mark.parametrize("width", [256, 3])
def test_caches_by_blocks(spark, monkeypatch, width):
    """Blocks of blocks give what going through a session does."""
    monkeypatch.setattr(sessions, "WIDTH", width)
    rng = random.Random(2)
    turns = [(s, t) for s in range(3) for t in range(0, 90, rng.choice([1, 2, 5]))]
    uses = [(s, t, p, f"c{rng.randint(0, 12)}") for s, t in turns for p in range(rng.randint(0, 5))] + [(7, 1, 0, "lost")]
    want = set()
    for s, t in turns:
        last = {}
        for s2, t2, p, c in uses:
            if s2 == s and t2 < t:
                last[c] = max(last.get(c, (-1, -1)), (t2, p))
        kept = sorted(sorted(last, key=lambda c: (tuple(-x for x in last[c]), c))[:4], key=lambda c: last[c])
        want |= {(s, t, c, i) for i, c in enumerate(kept, 1)}
    got = sessions.cache_before(spark.createDataFrame(turns, "session_id long, turn int"), spark.createDataFrame(uses, "session_id long, turn int, pos int, chunk_id string"), 4)
    assert dict(got.dtypes)["turn"] == "int" and {tuple(r) for r in got.collect()} == want and len(want) > 200


def test_vectors_alone(spark):
    """Without words the scores are similarities, cut to three times k before the filter."""
    chunks = spark.createDataFrame([(str(i), i, "a" if i < 4 else "b", "t", "s", 1, f"w{i}") for i in range(6)], "chunk_id string, chunk_ord long, vehicle_model string, doc_type string, section_path string, page int, text string")
    corpus = spark.createDataFrame([(str(i), [1.0 - i / 10, 0.0]) for i in range(6)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, "w5", "w5", "", ["b"], [1.0, 0.0], None), (2, "w1", "w1", "", None, [1.0, 0.0], None), (3, "w2", "w2", "", None, None, None)], "query_id long, question string, rewritten string, keyword string, models array<string>, rewritten_vector array<float>, keyword_vector array<float>")
    alone = retrieval.retrieve(asked, chunks, corpus, settings=retrieval.Settings(use_words=False, rewritten_k=2)).where("stage = 'rewritten'").collect()
    assert sorted((r.query_id, r.position, r.chunk_id, round(r.score, 6)) for r in alone) == [(1, 1, "4", 0.6), (1, 2, "5", 0.5), (2, 1, "0", 1.0), (2, 2, "1", 0.9)]
    both = retrieval.retrieve(asked, chunks, corpus).where("stage = 'final'").collect()
    assert {r.chunk_id for r in both if r.query_id == 3} == {"2"}  # words alone, as it has no vector
    typed = retrieval.retrieve(asked, chunks.withColumn("doc_type", F.when(F.col("chunk_id") == "0", "u").otherwise("t")), corpus, settings=retrieval.Settings(doc_types=("u",))).where("stage = 'final'").collect()
    assert {r.chunk_id for r in typed} == {"0"}


@pytest.mark.parametrize("block,held", [(4096, 100_000), (5, 30)])
def test_nearest_in_one_block_or_on_a_grid(spark, monkeypatch, block, held):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", held)
    rng = random.Random(5)
    corpus = [(f"c{i}", [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(150)]  # many ties
    asked = [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for i in range(17)]
    got = vectors.search(spark.createDataFrame(asked, "query_id long, embedding array<float>"), spark.createDataFrame([(c, e, "m", "t") for c, e in corpus], "chunk_id string, embedding array<float>, vehicle_model string, doc_type string").repartition(4), 5)
    want = set()
    for q, a in asked:
        best = sorted((-round(sum(x * y for x, y in zip(a, e, strict=True)), 9), c) for c, e in corpus)[:5]
        want |= {(q, c, -s, i) for i, (s, c) in enumerate(best, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert vectors.nearest(spark.createDataFrame([], "query_id long, embedding array<float>"), spark.createDataFrame([("c", [1.0])], "chunk_id string, embedding array<float>"), 3).count() == 0


def test_names_by_automaton(spark, monkeypatch):
    """The same rows as names tried one by one, on texts in which names overlap; and a registry of thousands."""
    rng = random.Random(11)
    names = [(f"m{rng.randint(0, 9)}", "".join(rng.choices("ab ", k=rng.randint(1, 5)))) for _ in range(40)]
    texts = ["".join(rng.choices("ABab \n", k=rng.randint(0, 25))) for _ in range(200)]
    frame = spark.createDataFrame([(i, x, texts[-1 - i] if i % 2 else None) for i, x in enumerate(texts)], "id long, t string, r string")
    got = []
    for most in (1000, 0):
        monkeypatch.setattr(routing, "FEW_NAMES", most)
        got.append({r.id: r.m for r in frame.select("id", routing.route(F.col("t"), F.col("r"), names).alias("m")).collect()})
    assert got[0] == got[1] and any(len(m) > 2 for m in got[0].values())
    many = [(f"n{i}", f"name{i}x") for i in range(5000)]
    one = spark.createDataFrame([("tell of name17x and Name 4321 X, not name9",)], "t string").select(routing.route(F.col("t"), F.lit(None).cast("string"), many).alias("m")).first().m
    assert one == ["n4321", "n17"]


def test_contents_in_retrieval(spark):
    """Leaves of each model apart, by words or by a completion, go before what the paths found."""
    chunks = spark.createDataFrame([(f"{m}{i}", 10 * k + i, m, "t", "s", i, f"w{i}") for k, m in enumerate("ab") for i in range(6)], "chunk_id string, chunk_ord long, vehicle_model string, doc_type string, section_path string, page int, text string")
    rows = [(m, p, p.split(">")[-1], i, 1 + p.count(">"), 2 * i, 2 * i + 1, leaf) for m in "ab" for i, (p, leaf) in enumerate([("oil and lamp", False), ("oil and lamp>oil", True), ("lamp", True)])]
    entries = spark.createDataFrame(rows, "vehicle_model string, path string, title string, ord int, level int, page int, end_page int, is_leaf boolean")
    corpus = spark.createDataFrame([("none", [0.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, "oil lamp", "oil lamp", "oil lamp", ["b"], None, None), (2, "lamp", "lamp", "", None, None, None)], "query_id long, question string, rewritten string, keyword string, models array<string>, rewritten_vector array<float>, keyword_vector array<float>")
    s = retrieval.Settings(entries=1, chunks_per_entry=2)

    def listed(**more):
        out: dict = {}
        for r in retrieval.retrieve(asked, chunks, corpus, entries, settings=more.pop("settings", s), **more).where("stage = 'contents'").collect():
            out.setdefault(r.query_id, []).append((r.position, r.chunk_id))
        return {q: [c for _, c in sorted(v)] for q, v in out.items()}

    assert listed() == {1: ["b2", "b3"], 2: ["a2", "a3", "b2", "b3"]}
    # an entry that has others below it: its range is chosen where leaves alone aren't asked for
    assert listed(settings=replace(s, leaf_only=False, entries=2))[2] == ["a2", "a3", "a0", "a1", "b2", "b3", "b0", "b1"]

    def choose():
        return lambda prompt: "2"

    assert listed(choose=choose) == {1: ["b4", "b5"], 2: ["a4", "a5", "b4", "b5"]}
