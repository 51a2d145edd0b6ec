"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import signature_join as sj
from quarryline.llm.components import components


def plain_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = [(i, plain_set(t)) for i, t in rows]
    name = {i: i for i, _ in rows}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                name[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def copies(rng: random.Random, groups: int, each: int, words: int) -> list[tuple[int, str]]:
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, words))
        if g % 3 == 0:
            base += passage
        for _ in range(rng.randint(1, each)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary).upper()
            texts.append(" ".join(t) if rng.random() < 0.8 else "\n ".join(t))
            base = t if rng.random() < 0.5 else base
    rng.shuffle(texts)
    return [(i * 7, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [4, 256])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(sj, "BLOCK", block)
    monkeypatch.setattr(sj, "SLICE", 3 if block == 4 else 4096)  # most keys are dealt in parts
    rows = copies(random.Random(11), 40, 12, 200) + [(10_001, None), (10_002, ""), (10_003, " \t"), (10_004, "one two"), (10_005, "ONE  two\n"), (10_006, "one two three")]
    got = sj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


@pytest.mark.parametrize("block", [4, 256])
def test_links(spark, monkeypatch, block):
    """Every link of a document counts once, in dense groups too; shingles are of as many words as asked."""
    monkeypatch.setattr(sj, "BLOCK", block)
    rows = copies(random.Random(5), 12, 25, 90) + [(10_001, None), (10_002, ""), (10_003, "one two"), (10_004, "ONE  two\n")]
    sets = {i: plain_set(t) for i, t in rows}
    want = {i: sum(1 for j, b in sets.items() if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)) for i, a in sets.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.n_links for r in sj.jaccard_components(docs, count_links=True).collect()} == want
    assert max(want.values()) > 5 and sum(want.values()) > 2 * len(rows)
    if block == 256:
        got = {r.doc_id: r.n_shingles for r in sj.jaccard_components(docs, words=2).collect()}
        pairs = lambda w: len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else len(w)
        assert got == {i: pairs((t or "").lower().split()) for i, t in rows}


def test_odd(spark, odd, none):
    got = sj.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert sj.jaccard_components(none).count() == 0
    kept = sj.keep_one_of_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 6, 7, 8]


def test_shingles():
    texts = ["", "a", "A b", "a b c d e", "a b c d e f a b c d e", "x y z\x0bw", "É é e é E é", "w " * 30]
    h, at = sj.shingles(pa.array(texts))
    assert list(np.diff(at)) == [len(plain_set(t)) for t in texts]
    again, _ = sj.shingles(pa.array(["a b c d e f a b c d e".upper()]))
    assert list(again) == list(h[at[4] : at[5]])


def test_trees():
    """Pruning loses no pair."""
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(60)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) > 0.05], rng.integers(0, 2**63, 3).astype(np.uint64)))) for b in base for _ in range(3)]
    x, y = sj.SignatureTree.of(sets[:100]), sj.SignatureTree.of(sets[60:])
    want = {(i, j) for i in range(100) for j in range(len(sets) - 60) if sj.linked(sets[i], sets[60 + j])}
    assert want <= set(sj.dual(x, y)) and want
    assert {(i, j) for i in range(100) for j in range(i + 1, 100) if sj.linked(sets[i], sets[j])} <= set(sj.dual(x, x, same=True))
    assert len(list(sj.dual(x, y))) < 4000


def test_prefixes():
    """Sets that link share as many keys of their prefixes as either needs, also where one is far larger."""
    rng = random.Random(12)
    seen = 0
    for _ in range(4000):
        n = rng.randint(1, 120)
        small = rng.sample(range(10_000), n)
        big = small[: n - rng.randint(0, n // 9)] + rng.sample(range(10_000, 20_000), rng.randint(0, n // 4))
        a, b = sorted(small, key=hash), sorted(set(big))
        order = {x: rng.random() for x in {*a, *b}}
        if 100 * len({*a} & {*b}) < 80 * len({*a} | {*b}):
            continue
        seen += 1
        x, y = ({*sorted(s, key=order.get)[: sj.prefix_size(len(s))]} for s in (a, b))
        assert len(x & y) >= max(sj.common_keys(len(a)), sj.common_keys(len(b)))
    assert seen > 1000


def test_graph(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    name = {}
    for a, b in links:
        x, y = sorted((name.get(a, a), name.get(b, b)))
        name |= {k: x for k in [a, b, *[k for k, v in name.items() if v in (x, y)]]}
    name = {k: v for k, v in name.items() if any(k != o for o in [x for l in links for x in l if k in l])}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: min(j for j, w in name.items() if w == v) for k, v in name.items()}
