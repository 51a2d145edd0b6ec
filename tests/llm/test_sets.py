"""Exact dedup, sharding, mixing and packing against brute force."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.llm import exact_dedup, mixing, packing, sharding


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_exact_dedup(spark, odd, none, keep, best):
    got = exact_dedup.exact_dedup(odd, keep=keep, fan_in=2).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[r.text or ""].append(r.doc_id)
    assert len(got) == odd.count()
    for r in got:
        ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids)
        assert r.keep_id == best((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups})
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_one_of_copies(odd, keep)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_runs_are_merged_in_order(spark):
    """Every round sorts what a node receives and keeps the first of equal neighbours; large groups of copies come through."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 700) END AS text").repartition(16)
    runs = exact_dedup.digests(docs).withColumn("row", F.monotonically_increasing_id())
    merged = exact_dedup.merge_runs(runs, fan_in=4, cells=16)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [node") == 2 and plan.count("Window [") >= 2
    want = defaultdict(list)
    for r in docs.collect():
        want[r.text].append(r.doc_id)
    got = merged.collect()
    assert sorted((r.keep_id, r.group_size) for r in got) == sorted((min(v), len(v)) for v in want.values())


def plain_shard(key: str, topology) -> int:
    """The descent by hand."""
    u = lambda node: (int(hashlib.md5(f"shards|{node}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    left, path = [t for t in topology if t[3] > 0], ()
    for level in range(3):
        weights = defaultdict(float)
        for t in left:
            weights[t[level]] += t[3]
        best = min(weights, key=lambda c: -math.log(u(".".join(map(str, (*path, c))))) / weights[c])
        left, path = [t for t in left if t[level] == best], (*path, best)
    return path[-1]


def test_sharding(spark, odd, none, tmp_path):
    """The query against plain Python, column by column."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op9_sharding(spark, str(tmp_path)).collect()
    want = Counter()
    for r in odd.collect():
        data, key = (r.text or "").encode(), "" if r.doc_id is None else str(r.doc_id)
        want[r.doc_id, len(data) + 1, zlib.crc32(data), "key", plain_shard(key, sharding.EIGHT), plain_shard(key, sharding.NINE)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(none, sharding.EIGHT).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(odd, sharding.EIGHT, sharding.balanced_topology(9))


def test_slots_of_equal_rows(spark):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS doc_id", "cast(id % 3 > 0 AS int) AS shard", "1L AS size", "7L AS text_crc32")
    got = sharding.slots(rows, rows_per_bin=64).groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert sorted((r.shard, r.n, r.lo, r.hi) for r in got) == [(0, 10_000, 0, 9_999), (1, 20_000, 0, 19_999)]


def test_sharding_draws(spark):
    """Shares follow the weights; movement stays in subtrees whose weights change."""
    ids = spark.range(6000)
    tree = [(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 2, 1.0), (1, 2, 3, 3.0), (1, 4, 5, 1.0), (2, 3, 4, 0.0)]
    heavier = [*tree[:2], (0, 1, 2, 3.0), *tree[3:]]
    key = F.col("id").cast("string")
    opened = sharding.with_region(tree, 9, 2.0)
    got = ids.select("id", *[sharding.descend(key, t).alias(n) for n, t in (("a", tree), ("b", heavier), ("c", opened))]).collect()
    assert all(r.a == plain_shard(str(r.id), tree) and r.b == plain_shard(str(r.id), heavier) for r in got)
    rack = {t[2]: t[:2] for t in tree}
    for r in got:
        if r.a != r.b:  # into the heavier region, in it into the heavier rack
            assert rack[r.b][0] == 0 and (rack[r.a][0] == 1 or rack[r.b] == (0, 1))
        assert r.a == r.c or r.c == 9
    n = Counter(r.a for r in got)
    assert all(n[s] == pytest.approx(6000 * w / 8, abs=180) for _, _, s, w in tree)
    # the hierarchy decides: leaf draws alone would place many documents elsewhere
    flat = lambda i: min(((-math.log((int(hashlib.md5(f"shards|{g}.{k}.{s}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w), s) for g, k, s, w in tree if w)[1]
    assert sum(flat(r.id) != r.a for r in got) > 1000
    with pytest.raises(ValueError):
        sharding.descend(key, [(0, 0, 0, 0.0)])


def fill(children, budget):
    """Water filling by repeated redistribution: name -> (capacity, weight)."""
    out, left = dict.fromkeys(children, 0.0), float(budget)
    open_ = {k for k, (c, w) in children.items() if c > 0 and w > 0}
    while left > 1e-9 and open_:
        total, add = sum(children[k][1] for k in open_), left
        for k in list(open_):
            got = min(add * children[k][1] / total, children[k][0] - out[k])
            out[k] += got
            left -= got
            if out[k] >= children[k][0] - 1e-9:
                open_.discard(k)
    return out


def test_budgets(spark):
    """The closed form equals redistribution in rounds, siblings before ancestors, and loses no token."""
    rows = [("a", "x", "1", 100), ("a", "x", "2", 5), ("a", "y", "3", 50), ("b", "x", "4", 1000), ("b", "z", "5", 7), ("c", "x", "6", 3)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = {"a": 3.0, "b": 1.0, "a/y": 2.0, "c": 0.5}
    for budget in (0, 10, 120, 200, 600, 5000):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, F.lit(budget), weights=weights).collect()}
        want = {(): min(budget, sum(r[3] for r in rows))}
        for i in range(3):
            for parent, b in list(want.items()):
                if len(parent) == i:
                    kids = {k: (sum(r[3] for r in rows if r[: i + 1] == k), weights.get("/".join(k), 1.0)) for k in {r[: i + 1] for r in rows if r[:i] == parent}}
                    want |= fill(kids, b)
        assert sum(got.values()) == min(budget, sum(r[3] for r in rows))
        assert all(abs(v - want[k]) <= 3 for k, v in got.items()), (budget, got, want)
        assert all(got[r[:3]] <= r[3] for r in rows)


def test_mix(spark, odd, none):
    levels = {"domain": F.lit("d"), "lang": F.col("lang"), "source": F.col("source")}
    everything = mixing.mix(odd, F.expr("total"), levels)
    assert everything.count() == odd.count() and set(odd.columns) < set(everything.columns)
    assert everything.where("mix_take <> mix_tokens").count() == 0
    twice = mixing.mix(odd, F.expr("2 * total"), levels, max_epochs=2)
    assert twice.groupBy("mix_epoch").count().orderBy("mix_epoch").collect() == [(0, 10), (1, 10)]
    assert mixing.mix(none, F.expr("total"), levels).count() == 0
    for budget in (1, 7, 20, 45):  # rows equal in id and text share a budget, null ids too
        for n, doc_id in ((6, "1"), (50, "CAST(NULL AS LONG)")):
            same = spark.range(n).selectExpr(f"{doc_id} AS doc_id", "'a b c d e f g h i j' AS text", "'en' AS lang", "'s' AS source")
            took = mixing.mix(same, F.lit(budget), levels).agg(F.sum("mix_take"), F.max("mix_take")).first()
            assert took[0] == budget and took[1] <= 10
    mixed_ids = spark.range(60).selectExpr("CASE WHEN id < 40 THEN NULL ELSE id % 5 END AS doc_id", "repeat('w ', 1 + cast(id % 4 AS int)) AS text", "'en' AS lang", "concat('s', id % 2) AS source")
    for budget in (10, 33, 90, 170):
        rows = mixing.mix(mixed_ids, F.lit(budget), levels, max_epochs=2).groupBy("mix_source").agg(F.sum("mix_take").alias("took"), F.max("mix_budget").alias("budget")).collect()
        assert sum(r.took for r in rows) == budget and all(r.took == r.budget for r in rows)
    half = mixing.mix(spark.range(500).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 7 AS int)) AS text", "'en' AS lang", "concat('s', id % 3) AS source"), F.expr("total div 2"), levels)
    leaf = half.groupBy("mix_source").agg(F.sum("mix_take").alias("took"), F.max("mix_budget").alias("budget")).collect()
    assert len(leaf) == 3 and all(r.took == r.budget for r in leaf)


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    v = packing.public_vocabulary()
    coder = Tokenizer.from_file(v["vocabulary"])
    docs = odd.unionByName(spark.createDataFrame([(90 + i, t) for i, t in enumerate(["  two  spaces\n\n here", "a  b   c", "it's <|endoftext|> x", "\n", "tab\t x ", "end ", " x", "日本 語 　 x", "\x1c a \x1d b"])], "doc_id long, text string"), allowMissingColumns=True)
    pieces = packing.pack(docs, **v, length=16).collect()
    want = sorted((r.doc_id or -1, *coder.encode(r.text or "", add_special_tokens=False).ids, 0) for r in docs.collect())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id or -1, p.sequence_id * 16 + p.offset - p.start].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and p.offset + p.length <= 16
        assert p.boundary == (p.length < p.doc_tokens)
    got = []
    for (d, _), ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        ids = b"".join(bytes(p.ids) for p in ps)
        got.append((d, *[int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]))
        assert [p.start for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))] and len(got[-1]) - 1 == ps[0].doc_tokens
    assert sorted(got) == want
    sizes = []
    for s in sorted(by_seq):
        at = 0
        for o, n in sorted(by_seq[s]):
            assert o == at
            at += n
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq))) and all(x == 16 for x in sizes[:-1])
    one = next(iter(packing.digest(packing.pack(docs, **v, length=16)).where("doc_id = 92 AND start = 0").collect()))
    assert one.ids_crc32 == zlib.crc32(next(bytes(p.ids) for p in pieces if p.doc_id == 92 and p.start == 0))
    assert packing.pack(none, **v).count() == 0


def structured(n: int) -> tuple[str, str]:
    """A sequence of two letters in which every part repeats with letters changed about, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_structured_texts_are_told_apart(spark, n):
    from tokenizers import Tokenizer

    from quarryline.llm import signature_join

    texts = dict(enumerate([*structured(n), *structured(n)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    coder = Tokenizer.from_file(packing.public_vocabulary()["vocabulary"])
    got = defaultdict(list)
    for r in packing.digest(packing.pack(docs, **packing.public_vocabulary())).collect():
        got[r.doc_id].append(r)
    for i, text in texts.items():
        ids = [*coder.encode(text, add_special_tokens=False).ids, 0]
        for r in got[i]:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
        assert sum(r.length for r in got[i]) == len(ids) == got[i][0].doc_tokens
    groups = {r.doc_id: (r.component_id, r.n_links) for r in signature_join.jaccard_components(docs, count_links=True).collect()}
    assert groups == {0: (0, 1), 1: (1, 1), 2: (0, 1), 3: (1, 1)}


def test_pieces_of_one_hash_are_compared(monkeypatch):
    """Where all pieces have one hash, each still gets its own ids."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(packing, "hash_lanes", lambda values, at, lengths: np.zeros(len(lengths), np.uint64))
    coder = packing.Pieces(**packing.public_vocabulary())
    texts = ["one two three", "", "one two two", "\u4f60\u597d one", "three"]
    ids, sizes = coder.encode(pa.array(texts))
    want = [coder.exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_clashing_names_keep_their_values(spark):
    from quarryline.llm import signature_join

    names = ["_order", "_copy", "_proof", "_kept_id", "order", "nth", "print", "empty", "doc", "own_0", "mix_take", "mix_tokens", "id", "proof"]
    rows = [(i, "a b c d e f g" if i < 2 else f"text {i} of its own here", "en", f"s{i % 2}", *[f"{n}-{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mixing.mix(docs, F.expr("total"), mixing.document_levels())
    for got, want in ((exact_dedup.keep_one_of_copies(docs, "smallest"), 5), (signature_join.keep_one_of_group(docs), 5), (mixed.select(*docs.columns), 6)):
        assert got.columns == docs.columns and got.count() == want
        for r in got.collect():
            assert all(r[n] == f"{n}-{r.doc_id}" for n in names)
    assert {"mix_take_", "mix_tokens_", "mix_budget"} <= set(mixed.columns)
