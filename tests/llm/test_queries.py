"""The queries of fingerprints, language identification and toxicity against plain versions, column by column."""

from __future__ import annotations

import hashlib
import math
import random
import unicodedata
import zlib

import pytest

from quarryline.llm import backoff, buffers, langid, toxicity
from quarryline.llm import fingerprints as fp
from quarryline.llm import treap_search as ts
from tests.llm.test_search import found, plain
from tests.llm.test_texts import plain_parse, plain_sketch

MOST = 2**64


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(31)
    ways = {"aa": (["cab", "bad", "fade", "deaf", "abbe"], [9, 5, 3, 2, 1]), "bb": (["cafe", "bead", "dab", "ebb", "face"], [1, 2, 3, 5, 9])}
    rows = []
    for i in range(160):
        lang = rng.choice(["aa", "bb"])
        text = " ".join(rng.choices(*ways[lang], k=rng.randint(3, 60)))
        if i % 4 == 0:
            text += " vilewort" * rng.randint(1, 4) + rng.choice([" v1lew0rt!", " vílewort", " vile​wort", " VILEWORT a!b !", ""])
        if i and i % 11 == 0:
            text = rows[i // 2][1]
        rows.append((3 * i, text, lang if i % 13 else None, "s", len(text or "")))
    rows += [(1000, None, "aa", "s", 0), (1001, "", None, "s", 0), (1002, "12 !", "bb", "s", 4), (1003, "ab", "aa", "s", 2)]
    path = tmp_path_factory.mktemp("queries")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("vile" in (t or ""))) for i, t, *_ in rows], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, rows[7 * i][1]) for i in range(5)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {r[0]: r[1] or "" for r in rows}


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def plain_hash(span: bytes) -> int:
    h = sum(int(buffers._BYTE[b]) * pow(0x9E3779B97F4A7C15, len(span) - 1 - i, MOST) for i, b in enumerate(span)) % MOST
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = ((h ^ (h >> shift)) * times) % MOST
    return h


def test_fingerprints(spark, sf_dir):
    path, texts = sf_dir
    assert plain_sketch(b"some bytes of a text", 8, 1.0) == {plain_hash(b"some bytes of a text"[i : i + 8]) for i in range(13)}

    def near(a: str, b: str) -> float:
        fraction = min(next(f for most, f in ((512, 1 / 4), (4_096, 1 / 16), (10**12, 1 / 48)) if len(t.encode()) - 7 <= most) for t in (a, b))
        x, y = (plain_sketch(t.encode(), 8, fraction) for t in (a, b))
        return 1.0 if a == b else len(x & y) / min(len(x), len(y)) if x and y else 0.0

    order = sorted(texts)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    got = fp.op3_fingerprints(spark, path).collect()
    assert len(got) == len(texts)
    prints: dict = {}
    for r in got:
        t, n = texts[r.doc_id], texts[after[r.doc_id]]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(near(t, e)) and r.near_next == pytest.approx(near(t, n))
        prints.setdefault(t, set()).add(r.fingerprint)
        prints.setdefault(e, set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_languages(spark, sf_dir):
    path, texts = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    samples = langid.learn(docs.where("NOT pmod(crc32(cast(doc_id AS string)), 5) = 0"))
    letters = lambda t: "".join(chr(c) if c else " " for c in langid.letters([t])[0])
    kept = {k: letters(t) for k, t in samples}
    for r in langid.op2_language_id(spark, path).collect():
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        t = letters(texts[r.doc_id])
        if not t.strip():
            assert (r.lang_pred, r.score) == ("und", 0)
        elif all(set(t) <= set(s) for s in kept.values()):
            bits = {k: plain_parse(t, s, langid.SEGMENT) * math.log2(max(2, len(s))) / len(t) for k, s in kept.items()}
            best, second = sorted(bits, key=lambda k: (bits[k], k))[:2]
            assert r.lang_pred == best and r.score == pytest.approx(1 - bits[best] / bits[second])


def plain_fold(text: str) -> list[str]:
    """Sign by sign: what each becomes, and signs that end a word."""
    kept = []
    for c in f" {text} ":
        if unicodedata.category(c) in ("Cf", "Mn", "Me") or 0xE0000 <= ord(c) < 0xE0200:
            continue
        x = unicodedata.normalize("NFKC", c).lower()
        bare = [k for k in unicodedata.normalize("NFKD", x) if not unicodedata.combining(k)]
        x = bare[0] if len(bare) == 1 else x
        x = toxicity.LOOK_ALIKES.get(x, toxicity.STANDS_FOR.get(x, x))
        kept.append((c, x if len(x) == 1 and x.isalpha() else " "))
    out = [x for _, x in kept]
    for i, (c, _) in enumerate(kept):
        if c in "!@$" and (kept[i + 1][1] == " " or (c == "!" and kept[i - 1][1] == " ")):
            out[i] = " "
    return "".join(out).split()


def test_toxicity(spark, sf_dir):
    path, texts = sf_dir
    docs, labels = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    lexicon, weights = toxicity.learn(docs, labels.where("NOT pmod(crc32(cast(doc_id AS string)), 5) = 0"))
    assert lexicon
    for r in toxicity.op6_toxicity(spark, path).collect():
        words = plain_fold(texts[r.doc_id])
        total = sum(w for x in words for e, w in lexicon if (x.startswith(e[:-1]) if e.endswith("*") else x == e))
        n = len(words)
        at = weights[0] + weights[1] * 10 * total / (n + 10) + weights[2] * math.log1p(total) + weights[3] * math.log1p(n) / 5
        want = 1 / (1 + math.exp(-max(-30, min(30, at))))
        assert r.held_out == held(r.doc_id) and r.score == pytest.approx(want) and r.predicted == int(want >= 0.5)


def test_folds_of_all_kinds():
    for text in ("You 1D10T!", "а!b ! !c", "été ＩＤ 𝐢𝐝 x\U000e0041y", "$5 @home $ a$ b@", "straße Ⅷ ﬁ İ"):
        assert toxicity.fold([text])[0].split() == plain_fold(text)


def test_search_and_scores(spark, sf_dir):
    """The queries of the three operators over whole tables agree with plain ones."""
    path, texts = sf_dir
    asked = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    assert found(ts.op11_treap_search(spark, path)) == {k: v for k, v in plain(list(texts.items()), asked).items() if v}
    from tests.llm.test_backoff import got
    from tests.llm.test_backoff import plain as plain_scores

    assert got(backoff.op13_backoff_scores(spark, path)) == plain_scores(list(texts.items()))
