"""Ranked search over treaps against the formula and against exhaustive scores."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import treap_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs: list[tuple], items: list[tuple], k: int = 10) -> dict:
    """Every document's score for every item."""
    words = [(i, terms(t)) for i, t in docs]
    n = sum(1 for _, w in words if w)
    length = sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = {}
    for item, text in items:
        asked, scored = terms(text), []
        for i, w in words:
            tf, m = Counter(w), 25 + (75 * len(w) * n) // length if length else 25
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if s > 0:
                scored.append((-s, i is not None, i))
        out[item] = [(r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def found(rows) -> dict:
    out: dict = {}
    for r in rows.collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_against_all_scores(spark, monkeypatch, seed):
    """Small blocks, several passes over the queries, ties and copies."""
    monkeypatch.setattr(treap_search, "POSTINGS", 200)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "你好", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, "w1 w2, w3"), (5, "w1-w2_w3"), (2000, None), (2001, ""), (2002, ".,;")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(20)] + [(50, docs[7][1]), (51, None), (52, ""), (53, "none of these"), (54, "w1 W1 w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items + items[:3], "item_id long, text string")
    want = {k: v for k, v in plain(docs, items).items() if v}
    assert found(treap_search.search(frame, asked, at_once=9 if seed else 2000)) == want


def test_odd(spark, odd, none):
    asked = spark.createDataFrame([(1, "a b long words", "x"), (2, "x" * 50_000, "y"), (None, "你好", None)], "item_id long, text string, rank string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(treap_search.search(odd, asked)) == {k: v for k, v in plain(docs, [(r.item_id, r.text) for r in asked.collect()]).items() if v}
    assert treap_search.search(none, asked).count() == 0 and treap_search.search(odd, asked.where("false")).count() == 0


def test_words_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(treap_search, "hash_lanes", lambda values, lane, lengths: np.zeros(len(lengths), np.uint64))
    asked = treap_search.Asked(["one three", "two"])
    import pyarrow as pa

    data, starts, ends, _ = treap_search.tokens(pa.array(["two one four three twofold", "on"]), treap_search._TERM)
    hit = asked.find(*treap_search.lanes(data, starts, ends), ends - starts)
    names = {}
    for q, text in ((0, "one three"), (1, "two")):
        for t in asked.term[asked.query == q].tolist():
            names.setdefault(q, []).append(t)
    assert hit[0] == names[1][0] and {hit[1], hit[3]} == set(names[0]) and hit[2] == hit[4] == hit[5] == -1


def test_pruning_leaves_most_documents_unread():
    """Where some documents stand out, few others are scored."""
    rng = np.random.default_rng(5)
    n = 20_000
    vocabulary = [f"t{i}" for i in range(40)]
    asked = treap_search.Asked([" ".join(vocabulary[i : i + 8]) for i in range(0, 32, 4)])
    held = rng.random((n, len(vocabulary))) < np.linspace(0.002, 0.1, len(vocabulary))
    held[rng.choice(n, 30, replace=False)] = True
    doc, term = np.nonzero(held)
    best = treap_search.Best(8, 10)
    args = (np.arange(n), rng.integers(50, 400, n), held.sum(1), term, rng.integers(1, 4, len(doc)), rng.integers(500, 4000, len(vocabulary)), n, 200 * n)
    treaps, ids = treap_search.block(*args)
    treap_search.traverse(treaps, ids, asked, best)
    score = np.zeros((8, n), np.int64)
    for q, t, x in zip(asked.query, asked.term, asked.times, strict=True):
        at = slice(*np.searchsorted(np.repeat(np.arange(len(vocabulary)), held.sum(0)), [t, t + 1]))
        score[q, treaps.doc[at]] += treaps.impact[at] * x
    for q in range(8):
        order = np.lexsort((np.arange(n), -score[q]))[:10]
        mine = best.query == q
        assert best.ident[mine].tolist() == order.tolist() and best.score[mine].tolist() == score[q][order].tolist()
    assert 10 * best.scored < (score > 0).sum()
