"""Personal data: base spans against plain patterns; labelers' reliabilities on votes of known truth."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarryline.llm import pii


def passes(kind: str, s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(t: str) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, t) if passes(k, m[0])]


TEXTS = [
    "", "no data", "é a@b.c.d+e@f.g and x@y a@b.com@c.de", "1.2.3.4.5.6.7.8 999.1.1.1 010.000.0255.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 " + "0" * 16,
    "+1 (555) 010-9999 call +44 20 7946 0958. +1((( +12", "日本 me@x.org +49 30 123456 10.0.0.1", "@@@ a@ @b.c", "1" * 5000 + " " + "1 " * 3000, "a" * 20_000 + "@", "x.y@z.w" * 500,
    "write to jane at example dot com or jane [at] example [dot] org", "call (555) 123-4567 now", "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = random.Random(9)
    bits = ["a@b.c", "+1 23 456 7890", "1.2.3.4", "4111 1111 1111 1111", " ", "x", "é", "-", ".", "@", "+", "7", "(", "12", "\n"]
    texts = TEXTS + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)]
    path = tmp_path_factory.mktemp("pii")
    spark.createDataFrame([*enumerate(texts), (9999, None)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return texts, {r.doc_id: r for r in pii.op1_pii(spark, str(path)).collect()}


def test_base(rows):
    texts, got = rows
    assert len(got) == len(texts) + 1 and got[9999].spans == ""
    for i, t in enumerate(texts):
        base = plain_base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (t[:200], base, got[i].spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert set(base) <= set(got[i].spans.split(",")) | {""}


def test_reliabilities():
    rng = random.Random(1)
    right, counts, truth = (0.95, 0.8, 0.7), {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.6
        votes = tuple(0 if rng.random() < 0.2 else (1 if y else -1) if rng.random() < r else (-1 if y else 1) for r in right)
        key = ("card", *votes, 1, 2)
        counts[key] = counts.get(key, 0) + 1
        truth[key] = truth.get(key, 0) + y
    share, chance, posterior = pii.reliabilities(counts)
    assert abs(share["card"] - 0.6) < 0.05
    for r, c in zip(right, chance, strict=True):
        assert abs(c[1][1] / (c[1][1] + c[-1][1]) - r) < 0.06
    fitted = pii.classifier(counts, posterior)
    agree = sum(c for k, c in counts.items() if (fitted[k] >= 0.5) == (truth[k] * 2 >= c))
    assert agree > 0.95 * 20_000
    assert pii.classifier({}, {}) == {} and pii.reliabilities({})[2] == {}


def test_spans(spark):
    """Places and the forty characters before, over many blocks of matches."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a@b.co ", "é@", "x.y@z.org", " tel ", "日本 ", "word " * 12]) for _ in range(n)) for n in (0, 1, 5, 64, 65, 700)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    column = rows.select("doc_id", pii.matches(F.col("text"), pii.BASE["email"], F.lit(True)).alias("m"))
    for r in pii.with_spans(column, ["m"]).collect():
        t = texts[r.doc_id]
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(PLAIN["email"], t)]
        assert [tuple(s)[:3] for s in r.m] == found
        assert [s.before for s in r.m] == [t[max(0, a - pii.LEFT) : a] for a, _, _ in found]


def test_without_overlaps(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        spans = []
        for kind in pii.KINDS:
            for base in (True, False):
                at = 0
                for _ in range(rng.choice([0, 1, 3, 90])):
                    at += rng.randint(0, 40)
                    n = rng.randint(1, 30)
                    spans.append((kind, at, at + n, base, 0.9))
                    at += n
        rows.append((i, spans))
    frame = spark.createDataFrame(rows, "doc_id long, found array<struct<kind string, start int, end int, base boolean, chance double>>")
    for r in pii.without_overlaps(frame).collect():
        spans = rows[r.doc_id][1]
        meet = lambda a, b: a[1] < b[2] and b[1] < a[2]
        rank = lambda s: pii.KINDS.index(s[0])
        base = [s for s in spans if s[3]]
        free = [s for s in spans if not s[3] and not any(meet(s, b) for b in base)]
        alone = [s for s in free if not any(rank(o) < rank(s) and meet(s, o) for o in free)]
        assert [tuple(s) for s in r.found] == sorted(base + alone, key=lambda s: (rank(s), s[1]))


def test_added(spark):
    """The classifier adds what base patterns miss where cues speak for it, and nothing in plain prose."""
    rng = random.Random(2)
    rows = [f"please write to jane{i} [at] example [dot] org or call (555) 123-4{i:03d} now; mail a{i}@b.com, phone +1 555 010 9{i:03d}" for i in range(120)]
    rows += [" ".join(rng.choices(["plain", "words", "of", "prose", "12", "3.5"], k=60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for r in pii.personal_data(docs).collect():
        new = [rows[r.doc_id][s.start : s.end] for s in r.found if not s.base]
        assert new == ([f"jane{r.doc_id} [at] example [dot] org", f"(555) 123-4{r.doc_id:03d}"] if r.doc_id < 120 else [])


def test_dense(spark):
    """Many spans in one text."""
    text = "a@b.co jane [at] x [dot] org 10.0.0.7 " * 4000
    got = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    assert sum(s.base for s in got) == 8000 and [text[s.start : s.end] for s in got[:2]][0] == "a@b.co"


def test_odd(spark, odd, none):
    assert pii.personal_data(odd).count() == odd.count() and pii.personal_data(none).count() == 0


def test_context_is_whole_behind_many_short_matches(spark):
    """Each match's 40 characters before it, however short the matches in them are."""
    text = "".join(f"+{i % 10} {(i * 7) % 10}" for i in range(30))
    hits = [(m.start(), m.end()) for m in re.finditer(r"\+[0-9] [0-9]", text)]
    rows = pii.matches(F.col("text"), r"\+[0-9] [0-9]", F.lit(True))
    frame = spark.createDataFrame([(text,)], "text string").withColumn("p", rows)
    behind = F.transform("p", lambda _, i: F.right(F.array_join(F.transform(F.slice("p", F.greatest(i - pii.BEHIND, F.lit(0)) + 1, F.least(i, F.lit(pii.BEHIND))), lambda p: F.concat(p["tail"], p["hit"])), ""), F.lit(pii.LEFT)))
    assert frame.select(behind).first()[0] == [text[max(0, a - 40) : a] for a, _ in hits]
