"""Language model scores against plain counts and a plain sum."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import backoff

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def words(text: str | None) -> list:
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def is_held(i: int | None) -> bool:
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def plain(docs: list[tuple], prior: float = backoff.PRIOR) -> Counter:
    train = [words(t) for i, t in docs if not is_held(i)]
    c = Counter(w for ws in train for w in ws)
    c2 = Counter(p for ws in train for p in zip(ws, ws[1:], strict=False))
    n, v = sum(c.values()), len(c)
    unseen = sum(1 for x in c2.values() if x == 1) / sum(c2.values()) if c2 else 1.0
    p1 = lambda w: (c[w] + 1) / (n + v + 1)

    def p(before: object, w: object) -> float:
        if not c[before]:
            return p1(w)
        return (1 - unseen) * c2[before, w] / (c[before] + prior) + (unseen * c[before] + prior) / (c[before] + prior) * p1(w)

    out = Counter()
    for i, t in docs:
        ws = words(t)
        base = sum(math.log10(p1(w)) for w in ws)
        score = math.log10(p1(ws[0])) + sum(math.log10(p(a, b)) for a, b in zip(ws, ws[1:], strict=False))
        out[i, is_held(i), len(ws), sum(1 for w in ws if c[w]), n, round(base, 6), round(score, 6)] += 1
    return out


def got(rows) -> Counter:
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows.collect())


@pytest.mark.parametrize("block,bucket,step", [(16 << 20, 2_000_000, 1024), (700, 50, 3)])
def test_against_plain_counts(spark, monkeypatch, block, bucket, step):
    for name, value in (("BLOCK", block), ("BUCKET", bucket), ("STEP", step)):
        monkeypatch.setattr(backoff, name, value)
    rng = random.Random(3)
    names = [f"w{i}" for i in range(50)] + ["Über", "你好", "A,b"]
    docs = [(i, " ".join(rng.choices(names, [1 / (k + 1) for k in range(len(names))], k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(200 + i, docs[5][1]) for i in range(20)] + [(300, None), (301, ""), (302, " \t\n"), (None, "w1 w2 unheard"), (7, "never w1 seen w2"), (303, "x" * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(backoff.score(frame, backoff.held_out())) == plain(docs)


def test_odd(spark, odd, none):
    assert got(backoff.score(odd, backoff.held_out())) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert backoff.score(none, backoff.held_out()).count() == 0
    # nothing to learn from
    held = [i for i in range(60) if is_held(i)]
    docs = [(i, "a b") for i in held[:3]] + [(None, None)]
    assert got(backoff.score(spark.createDataFrame(docs, "doc_id long, text string"), backoff.held_out())) == plain(docs)


def test_probabilities_add_up():
    """From every state, over all known words and one unknown."""
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 5, 399), 5)  # 5 is the end, which nothing follows; 6 is unknown
    c, pairs, c2 = np.bincount(text, minlength=7), *np.unique(text[:-1] * 7 + text[1:], return_counts=True)
    a = backoff.Automaton.of_bigrams(c, pairs, c2, 400, 6, 0.2, 2.0)
    for state in range(6):
        assert abs(sum(10 ** a.walk(np.array([w]), np.array([0, 1]), np.array([state]))[0] for w in range(7)) - 1) < 1e-12


def test_numbers_are_packed():
    for x in ([], [0], [255, 256], [2**64 - 1, 3, 2**40]):
        assert backoff.unpacked(backoff.packed(np.array(x, np.uint64))).tolist() == x


def test_held_out_texts_gain(spark):
    """Word order is learned: held-out texts score above their base."""
    rng = random.Random(9)
    follow = {w: rng.sample(range(300), 4) for w in range(300)}

    def text() -> str:
        w, out = rng.randrange(300), []
        for _ in range(60):
            out.append(f"v{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    docs = [(i, text()) for i in range(400)]
    rows = [r for r in backoff.score(spark.createDataFrame(docs, "doc_id long, text string"), backoff.held_out()).collect() if r.held_out]
    assert sum(r.score for r in rows) / sum(r.base_score for r in rows) < 0.5
