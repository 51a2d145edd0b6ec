"""The pipeline's rows against the stages done plainly on a small table."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarryline.llm import mixing, packing, toxicity
from tests.llm.test_join import brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(12)]
    rows = []
    for i in range(260):
        if rows and i % 6 == 0:
            text = rng.choice(rows)[1]
        elif rows and i % 6 == 1:
            t = rng.choice(rows)[1].split(" ")
            t[rng.randrange(len(t))] = "changed"
            text = " ".join(t)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randint(8, 90)))
            if i % 6 == 2:
                text = " ".join(w if rng.random() < 0.8 else "vilewort" for w in text.split(" "))
        rows.append((i, text, rng.choice(["en", "de"]), f"s{rng.choice([0, 0, 0, 1, 2])}", len(text)))
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("vilewort" in r[1])) for r in rows], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, sf_dir):
    path, rows = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    kept = set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, before = docs.columns, kept
        docs = corpus_pipeline.written(stage(spark, docs, path), "test")
        assert docs.columns == columns
        got = [r.doc_id for r in docs.select("doc_id").collect()]
        kept = set(got)
        assert len(kept) == len(got) and kept <= before
        if name == "toxicity":
            assert kept == {i for i in before if "vilewort" not in texts[i]}
        elif name == "exact dedup":
            assert kept == set({texts[i]: i for i in sorted(before)}.values())
        elif name == "n-gram Jaccard join":
            assert kept == {c for _, c in brute([(i, texts[i]) for i in sorted(before)]).values()}
        else:
            words = {i: len(texts[i].split(" ")) for i in before}
            assert 0.9 * sum(words.values()) - 1 <= sum(words[i] for i in kept) < sum(words.values())
    coder = Tokenizer.from_file(packing.public_vocabulary()["vocabulary"])
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, path).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == kept
    for i, ps in pieces.items():
        ids = [*coder.encode(texts[i], add_special_tokens=False).ids, 0]
        assert sorted((p.start, p.length, p.ids_crc32) for p in ps) == sorted((p.start, p.length, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length]))) for p in ps)
        assert sum(p.length for p in ps) == len(ids) == ps[0].doc_tokens


def test_odd(spark, odd, none, sf_dir):
    """Every stage takes nulls, long texts, repeated rows, clashing names and empty tables, and gives what its docstring says."""
    stages = dict(corpus_pipeline.STAGES)
    rows = odd.count()
    for name in ("toxicity", "exact dedup", "n-gram Jaccard join"):
        kept = stages[name](spark, odd, sf_dir[0])
        assert kept.columns == odd.columns
        got = [tuple(r) for r in kept.collect()]
        every = [tuple(r) for r in odd.collect()]
        assert all(r in every for r in got)
        if name == "exact dedup":
            assert len(got) == len({r[1] or "" for r in every}) == len({r[1] or "" for r in got})
        elif name == "toxicity":
            assert len(got) == rows
        else:
            assert [r[0] for r in got].count(1) == 1 and 2 not in [r[0] for r in got] and {3, 4, 6, 7, 8} <= {r[0] for r in got}
    mixed = stages["mixing sources to target weights"](spark, odd, sf_dir[0])
    assert mixed.columns == odd.columns and 0 < mixed.count() <= rows
    packed = stages["packing"](spark, odd, sf_dir[0]).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0) and {r.doc_id for r in packed} == {r.doc_id for r in odd.collect()}
    for stage in stages.values():
        assert stage(spark, none, sf_dir[0]).count() == 0
    assert toxicity.read_labels(spark, sf_dir[0]).count() == 260 and list(mixing.document_levels()) == list(mixing.LEVELS)
