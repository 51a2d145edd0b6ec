"""Fingerprints, language identification and toxicity against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import fingerprints as fp
from quarryline.llm import langid, toxicity


def plain_sketch(text: bytes, width: int, fraction: float) -> set[int]:
    spans = [text[i : i + width] for i in range(len(text) - width + 1)]
    if not text:
        return set()
    if not spans:
        hashes = [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big")]
    else:
        hashes = [int(fp.shingle_hashes(np.frombuffer(s, np.uint8), width)[0]) for s in spans]
    return {h for h in hashes if h < int(fraction * 2**64)}


def test_sketches():
    rng = random.Random(3)
    texts = [b"", b"ab", b"same same same same", *[bytes(rng.choices(b"abc de", k=n)) for n in (15, 16, 17, 400, 70_000)]]
    got = fp.sketches(*fp._batch(texts), 16, ((None, 1 / 4),))
    for t, s in zip(texts, got, strict=True):
        assert list(s) == sorted(set(map(int, s)))
        if len(t) < 1000:
            assert set(map(int, s)) == plain_sketch(t, 16, 1 / 4)
    big, part = bytes(rng.choices(range(97, 123), k=60_000)), slice(1000, 6000)
    a, b, c, d = fp.sketches(*fp._batch([big, big[part], big[3000:9000], big[5000:5300]]))
    least = fp.FRACTIONS[-1][1]
    assert fp.containment(a, b, least) > 0.99 and 0.4 < fp.containment(b, c, least) < 0.8
    assert fp.containment(fp.merged(b, c, least), a, least) > 0.99 and fp.containment(a, a[:0], least) == 0
    # of a short text more is retained than of a long one, whose threshold both are compared at
    assert len(d) > 50 and len(fp.cut(d, least)) < 20 and fp.containment(a, d, least) == 1


def test_fractions():
    """Each text retains what lies below its own fraction; a long text's fingerprint is below an eighth of it."""
    rng = random.Random(5)
    for n, fraction in ((8, 1 / 4), (519, 1 / 4), (520, 1 / 16), (4_103, 1 / 16), (4_104, 1 / 48), (14_000, 1 / 48)):
        text = bytes(rng.choices(range(97, 123), k=n))
        (s,) = fp.sketches(*fp._batch([text]))
        assert fp.fraction_of(fp.n_shingles(n)) == fraction and set(map(int, s)) == plain_sketch(text, fp.WIDTH, fraction)
    shown = fp._shown(text, s, fp.WIDTH)
    assert len(shown) < len(text) / 8 and len(base64.b64decode(shown.split(":")[2])) == 4 * len(s)


def test_compare_with_edits(spark, odd, none):
    got = fp.compare_with_edits(odd).collect()
    order = sorted(odd.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    assert len(got) == len(order)
    texts = {r.doc_id: r.text or "" for r in order}
    for r in got:
        if r.doc_id in (2, 3, 4, 6, 7):  # ids of one row whose successor has one row
            nxt = {2: 3, 3: 4, 4: 6, 6: 7, 7: 8}[r.doc_id]
            t, n = texts[r.doc_id], texts[nxt]
            e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert fp.compare_with_edits(none).count() == 0 and fp.fingerprints(none).count() == 0
    plain = {(r.doc_id, r.fingerprint) for r in fp.fingerprints(odd).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in got}


def test_short_texts():
    """Short texts share retained hashes with their edited ones."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghij klmnop", k=rng.randint(32, 64))) for _ in range(400)]
    after = [fp.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    own, new = (fp.sketches(*fp._batch([t.encode() for t in some])) for some in (texts, after))
    near = [fp.containment(a, b, fp.FRACTIONS[0][1]) for a, b in zip(own, new, strict=True)]
    assert sum(n == 0 for n in near) < 20 and not any(len(s) == 0 for s in own)


@pytest.mark.parametrize("n", [1, 7, 300])
def test_successors(spark, n):
    """Every document meets its successor over the bounds of bins, the last the first."""
    docs = spark.range(n).selectExpr("id * 3 AS doc_id", "concat('text number ', id, ' ', repeat(chr(cast(97 + id % 26 AS int)), 30)) AS text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in fp.compare_with_edits(docs).collect():
        t, nxt = texts[r.doc_id], texts[(r.doc_id // 3 + 1) % n * 3]
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()


def plain_parse(text: str, sample: str, segment: int) -> int:
    n = 0
    for lo in range(0, len(text), segment):
        seg, at = text[lo : lo + segment], 0
        while at < len(seg):
            k = 1
            while at + k <= len(seg) and seg[at : at + k] in sample:
                k += 1
            at += max(1, k - 1)
            n += 1
    return n


def test_cross_parse():
    rng = random.Random(5)
    samples = (("a", "".join(rng.choices("abcde ", k=400))), ("b", "".join(rng.choices("cdefg ", k=300))))
    parser = langid.CrossParser(samples)
    plain = lambda t: "".join(chr(c) if c else " " for c in langid.letters([t])[0])
    texts = ["", "a", "abc", "zz", *["".join(rng.choices("abcdefgz  ", k=k)) for k in (10, 255, 256, 257, 900)]]
    phrases, _, _ = parser.phrases(texts)
    for i, (_, sample) in enumerate(samples):
        for j, t in enumerate(texts):
            want = plain_parse(plain(t), plain(sample), langid.SEGMENT)
            got = phrases[i, j]
            # a letter that the sample lacks ends the phrase before it and, if the next begins afresh, is none itself
            assert got >= 0 and abs(int(got) - want) <= plain(t).count("z") + plain(t).count("f") + plain(t).count("g") + plain(t).count("a") + plain(t).count("b") + 1
            if set(plain(t)) <= set(sample):
                assert got == want


def test_symbols():
    """Letters of any rank have codes of their own, none the beginning of another."""
    ranks = np.array([*range(1500), 17_071, 17_072, 17_073, 140_000, -1])
    out, size = langid.in_symbols(ranks)
    at = np.concatenate(([0], np.cumsum(size)))
    codes = [tuple(out[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    assert len(set(codes)) == len(ranks) and codes[-1] == (0,) and set(size) == {1, 2, 3, 4}
    assert not any(c[:k] in set(codes) for c in codes for k in range(1, len(c))) and out.max() <= 64


def test_ideographs():
    """Languages that share hundreds of letters are told apart, beside languages of few."""
    ideographs = [chr(0x4E00 + i) for i in range(600)]
    rng = random.Random(3)
    vocabulary = {k: ["".join(rng.choices(ideographs, k=rng.randint(1, 3))) for _ in range(400)] for k in ("ja", "zh")}
    vocabulary |= {k: [" " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü"[i : i + 20], k=5)) for _ in range(400)] for i, k in enumerate(("l1", "l2", "l3"))}
    parser = langid.CrossParser(tuple((k, "".join(rng.choices(v, k=24_000))[:24_000]) for k, v in sorted(vocabulary.items())))
    for k, v in vocabulary.items():
        langs, _ = parser.predict(["".join(rng.choices(v, k=20)) for _ in range(60)])
        assert langs == [k] * 60
    samples = (("ja", "".join(rng.choices(vocabulary["ja"], k=150))), ("zh", "".join(rng.choices(vocabulary["zh"], k=150))))
    parser = langid.CrossParser(samples)
    coded = lambda t: "".join(chr(32 + x) for x in parser.symbols(langid.letters([t])[0])[0])
    texts = ["".join(rng.choices(vocabulary[k], k=30)) for k in ("ja", "zh", "ja")]
    phrases, size, _ = parser.phrases(texts)
    assert list(size) == [len(coded(t)) for t in texts]
    for i, (_, sample) in enumerate(samples):
        for j, t in enumerate(texts):
            if not set(coded(t)) - set(coded(sample)):
                assert phrases[i, j] == plain_parse(coded(t), coded(sample), langid.SEGMENT)


def test_identify(spark, odd, none):
    samples = (("en", "the cat and the dog are in the house " * 20), ("fr", "le chat et le chien sont dans la maison " * 20))
    docs = spark.createDataFrame([(1, "The dog and the cat"), (2, "le chien et la maison"), (3, None), (4, "123 !"), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, samples).collect()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und"}
    assert all(0 <= r.score <= 1 for r in langid.identify(odd, samples).collect())
    assert langid.identify(odd, samples).count() == odd.count() and langid.identify(none, samples).count() == 0
    assert langid.learn(none) == () and {r.lang_pred for r in langid.identify(odd, ()).collect()} == {"und"}
    assert [k for k, _ in langid.learn(odd)] == ["de", "en", "fr"]


def test_fold_and_measure():
    lexicon = (("idiot", 2.0), ("stup*", 1.5), ("trash", 1.0))
    text = ["You 1D10T!", "іdiоt", "idiots", "stupid stupor", "trash can and trash", "", "a-trash-b", "ＩＤＩＯＴ", "𝐢𝐝𝐢𝐨𝐭 you", "id\u200biot", "i\u0308dïot\U000e0041 x", "\u200b"]
    total, words = toxicity.measure(text, lexicon)
    assert list(total) == [2.0, 2.0, 0.0, 3.0, 1.0, 0.0, 1.0, 2.0, 2.0, 2.0, 2.0, 0.0]
    assert list(words) == [2, 1, 1, 2, 4, 0, 3, 1, 2, 1, 2, 0]


def plain_score(text: str, model: tuple) -> float:
    """Word by word, without an automaton: folded words, exceptions blanked, every entry tried."""
    lexicon, weights = model
    found = toxicity.fold([text])[0].split()
    blank = [False] * len(found)
    for phrase in toxicity.EXCEPTIONS:
        parts = phrase.split(" ")
        for i in range(len(found) - len(parts) + 1):
            if found[i : i + len(parts)] == parts:
                blank[i : i + len(parts)] = [True] * len(parts)
    total = sum(w for x, b in zip(found, blank, strict=True) if not b for e, w in lexicon if (x.startswith(e[:-1]) if e.endswith("*") else x == e))
    n = len(found)
    at = weights[0] + weights[1] * 10 * total / (n + 10) + weights[2] * np.log1p(total) + weights[3] * np.log1p(n) / 5
    return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))


def test_toxicity(spark, odd, none):
    rng = random.Random(7)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(8)]
    rows = []
    for i in range(400):
        t = rng.choices(words, k=rng.randint(10, 80))
        if i % 5 == 0:
            for _ in range(1 + len(t) // 12):
                t[rng.randrange(len(t))] = rng.choice(["vilewort", "nastig", "nastiger"])
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels.where("doc_id < 300"))
    assert {e for e, _ in model[0]} & {"vilewort", "vile*", "vilewort*", "vilew*", "vilewo*", "vilewor*"}
    got = {r.doc_id: r for r in toxicity.rate(docs, model).collect()}
    assert sum(got[i].predicted == (i % 5 == 0) for i in range(300, 400)) >= 97
    assert {r.doc_id for r in toxicity.keep_harmless(docs, model).collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.rate(odd, model).count() == odd.count() and toxicity.rate(none, model).count() == 0
    assert toxicity.keep_harmless(odd, model).columns == odd.columns
    odder = [(1000, "Trash can NASTIGER vilewort-x"), (1001, "v1lew0rt trash"), (1002, None), (1003, "vilewort " * 5000)]
    texts = {**dict(rows), **dict(odder)}
    model = (tuple(sorted({**dict(model[0]), "trash": 1.5}.items())), model[1])
    for r in toxicity.rate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect():
        want = plain_score(texts[r.doc_id] or "", model)
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.5)
    # more strong entries than any fixed number: all are in the lexicon
    many = [f"{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}q" for i in range(20) for j in range(20) for k in range(2)]
    bad = spark.createDataFrame([(i, 1, " ".join(many)) for i in range(60)] + [(100 + i, 0, "plain words of a kind " * 900) for i in range(200)], "doc_id long, toxic int, text string")
    assert len(toxicity.learn(bad, bad.select("doc_id", "toxic"))[0]) == len(many)
    blank = toxicity.learn(docs, labels.where("doc_id < 0"))
    assert all(r.predicted == 0 for r in toxicity.rate(odd, blank).collect())
