"""The generation of samples: gate, plan, quality, dedup, ledgers, split, report."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions.text import question_key, sample_id
from quarryline.operators import completion, corpus_gen, export, quality, routing
from quarryline.sources import corpus

GATE = [
    ([("seed", 0.5, "A"), ("c2", 0.46, "A"), ("c3", 0.2, "B")], "full", False, "strong"),
    ([("c2", 0.5, "A"), ("c3", 0.4, "A")], "full", False, "seed_not_returned"),
    ([("seed", 0.4, "A")], "full", False, "single_chunk_full"),
    ([("seed", 0.4, "A")], "partial", False, "too_few_chunks"),
    ([("seed", 0.32, "A"), ("c2", 0.31, "A")], "partial", False, "partial_ok"),
    ([("seed", 0.5, "A"), ("c2", 0.46, "A")], "full", True, "evidence_conflict"),
    ([("seed", 0.1, "A"), ("c2", 0.1, "A")], "full", False, "low_score"),
    ([("seed", 0.4, "A"), ("c2", 0.35, "B")], "full", False, "ok"),
    ([("seed", 0.4, "A"), ("c2", 0.35, "B")], "no", False, "insufficient_evidence"),
]


def test_gate(spark):
    rows = [(str(i), pos, c, s, sec) for i, (found, *_) in enumerate(GATE) for pos, (c, s, sec) in enumerate(found)]
    retrieved = spark.createDataFrame(rows, "qid string, pos int, chunk_id string, score double, section_path string")
    plan = spark.createDataFrame([(str(i), "seed", "A", label, conflict) for i, (_, label, conflict, _) in enumerate(GATE)], "qid string, chunk_id string, section_path string, label string, conflict boolean")
    got = corpus_gen.gate_signals(retrieved, plan).join(plan.select("qid", "label", "conflict"), "qid").withColumn("verdict", corpus_gen.gate(F.col("label"), F.col("conflict")))
    assert {r.qid: r.verdict for r in got.collect()} == {str(i): want for i, (*_, want) in enumerate(GATE)}


@pytest.mark.parametrize("seed", range(4))
def test_quota_and_stop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["partial_ok", "partial_ok", "ok", "strong", "low_score"]), rng.random() < 0.7) for i in range(120)]
    target, most, prior, before = 30, 90, 3, 1
    want, had, partials = {}, prior, before
    for i, verdict, good in rows[:most]:
        if had >= target:
            want[i] = (None, False)
        elif verdict == "partial_ok" and partials >= int(0.2 * target):
            want[i] = ("partial_quota_full", False)
        elif verdict == "low_score":
            want[i] = (verdict, False)
        elif not good:
            want[i] = ("quality", False)
        else:
            want[i] = (verdict, True)
            had += 1
            partials += verdict == "partial_ok"
    got = corpus_gen.quota_and_stop(spark.createDataFrame(rows, "plan_ord long, verdict string, quality_ok boolean"), target, 0.2, most, prior, before)
    assert {r.plan_ord: (r.outcome, r.accepted) for r in got.collect()} == want


def test_plan(spark):
    rows = [(m, f"{m}{i}", "x") for m in "ABC" for i in range(20)]
    chunks = spark.createDataFrame(rows, "vehicle_model string, chunk_id string, section_path string")
    count = lambda df: {r.model_id: r["count"] for r in df.groupBy("model_id").count().collect()}
    assert count(corpus_gen.sampling_plan(chunks, 12)) == {"A": 4, "B": 4, "C": 4}
    few = chunks.where("vehicle_model = 'A' OR chunk_id IN ('B0', 'B1')")
    assert count(corpus_gen.sampling_plan(few, 100, 5)) == {"A": 5, "B": 2}
    plan = corpus_gen.sampling_plan(chunks, 7)
    assert [r.model_id for r in plan.orderBy("plan_ord").collect()] == list("ABCABCA")
    assert {r.model_id for r in corpus_gen.under_minimum(plan, spark.createDataFrame([("A",), ("B",), ("D",)], "model_id string"), 3).collect()} == {"B", "D"}


def test_sections(spark):
    got = spark.createDataFrame([("故障>警告灯",), ("名词解释",), ("更换轮胎",), ("儿童安全",), ("其他",), ("故障检查",)], "s string").select(corpus_gen.task_type(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["故障分析", "术语解释", "步骤指导", "安全提醒", "直接问答", "故障分析"]
    rows = spark.createDataFrame([("x" * 300, "正文"), ("x" * 300, "目录"), (" x ", "正文")], "t string, s string")
    assert [r[0] for r in rows.select(corpus_gen.usable(F.col("t"), F.col("s"))).collect()] == [True, False, False]


def test_quality(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(quality.strip_leaks(F.lit(" 根据手册，胎压为 2.5 bar[3] 。"))) == "胎压为 2.5 bar 。"
    numbers = lambda out, ev: one(quality.ungrounded_numbers(F.lit(out), F.lit(ev)))
    assert numbers("压力 2.5 bar", "标准 2.5bar") == [] and numbers("压力 3.0 bar", "标准 2.5bar") == ["3.0bar"]
    assert numbers("3 km", "13") == [] and numbers("8 ℃ 和 30 KM/H", "无") == ["8℃", "30KM/H"]
    assert one(quality.absent_words(F.lit("免费，绝对"), F.lit("x"), quality.OVER_PROMISES)) == ["免费", "绝对"]
    assert one(quality.absent_words(F.lit("保险"), F.lit("保险"), quality.INSURANCE)) == []
    assert one(quality.unguarded(F.lit("高压部件"))) and not one(quality.unguarded(F.lit("高压部件，请联系服务中心")))
    fail = lambda out, ev="证据", foreign=(), ins="问", n=100: one(quality.first_failure(F.lit(ins), F.lit(out), F.lit(ev), F.lit(list(foreign)) if foreign else F.array().cast("array<string>"), F.lit(n)))
    assert fail("好") is None and fail("好", foreign=["m2"]) == "vehicle_conflict" and fail("9 bar") == "ungrounded_number" and fail("保险") == "insurance_warranty_mix"
    none = F.array().cast("array<string>")
    whole = lambda out, q, foreign=none, n=100: one(quality.failure(F.lit("问"), F.lit(out), F.lit("证据"), foreign, F.lit(n), question=F.lit(q)))
    assert whole("好", " ") == ("field_incomplete", "") and whole("好", "问") is None and whole("好", None) == ("field_incomplete", "")
    assert whole("9 bar", "q") == ("ungrounded_number", "nums=['9bar']") and whole("好", "q", F.array(F.lit("m2"))) == ("vehicle_conflict", "foreign=['m2']")
    assert whole("永久", "q") == ("over_promise", "words=['永久']") and whole("好" * 9, "q", n=8) == ("length_out_of_bounds", "len=9")
    assert fail("起火") == "unsafe_danger_advice" and fail("永久") == "over_promise" and fail("") == "field_incomplete" and fail("好" * 9, n=8) == "length_out_of_bounds"


def test_questions(spark):
    rows = spark.createDataFrame([(0, "怎么 办？"), (1, "怎么办?"), (2, "Other"), (3, " other "), (4, "new")], "plan_ord long, question string")
    seen = rows.where("plan_ord = 4").select(question_key(F.col("question")).alias("question_key"))
    assert {r.plan_ord: r.duplicate for r in corpus_gen.first_questions(rows, seen).collect()} == {0: False, 1: True, 2: False, 3: True, 4: True}
    a, b = spark.range(1).select(sample_id(F.lit("m"), F.lit("c"), F.lit("t")), sample_id(F.lit("m"), F.lit("c"), F.lit("u"))).first()
    assert a != b and a[0] == "Q" and len(a) == 11


def test_ledgers(spark, tmp_path):
    path = f"file://{tmp_path}/accepted"
    assert corpus.read_ledger(spark, path, corpus.ACCEPTED).count() == 0
    rows = spark.createDataFrame([("Q1", ("m", "t", "partial_ok", "q one"), ("i", "q", "a"))], corpus.ACCEPTED)
    corpus.append_ledger(rows, path)
    corpus.append_ledger(rows.withColumn("qid", F.lit("Q3")), path)
    back = corpus.read_ledger(spark, path, corpus.ACCEPTED)
    assert {r.qid for r in back.collect()} == {"Q1", "Q3"} and back.where("meta.accept_tier = 'partial_ok'").count() == 2
    rejected = spark.createDataFrame([("Q2",)], "qid string")
    plan = spark.createDataFrame([("Q1",), ("Q2",), ("Q4",)], "qid string")
    assert [r.qid for r in corpus_gen.pending(plan, back, rejected).collect()] == ["Q4"]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"chunk_ids": ["a", "b"], "texts": ["x", "y"], "metadatas": [{"vehicle_model": "m", "page": 3}, {}]}')
    got = corpus.read_corpus_json(spark, f"file://{tmp_path}/c.json").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text, r.vehicle_model, r.page) for r in got] == [("a", "x", "m", 3), ("b", "y", "", None)]
    (tmp_path / "bad.json").write_text('{"chunk_ids": ["a"], "texts": [], "metadatas": []}')
    with pytest.raises(Exception, match="differ in length"):
        corpus.read_corpus_json(spark, f"file://{tmp_path}/bad.json").collect()
    (tmp_path / "t.json").write_text('{"entries": [{"level": 1, "title": "A", "page": 2, "path": "A"}]}')
    assert corpus.read_toc_json(spark, f"file://{tmp_path}/t.json").first().title == "A"


def test_split_and_report(spark):
    rows = spark.createDataFrame([(f"q{i}", "a" if i < 8 else "b") for i in range(10)], "qid string, task_type string")
    assert {(r.task_type, r.split): r["count"] for r in export.split(rows, 0.5).groupBy("task_type", "split").count().collect()} == {("a", "train"): 4, ("a", "dev"): 4, ("b", "train"): 1, ("b", "dev"): 1}
    accepted = spark.createDataFrame([("strong", "a", "m"), ("strong", "b", "m"), ("ok", "a", "n"), ("partial_ok", "a", "m")], "accept_tier string, task_type string, model_id string")
    rejected = spark.createDataFrame([("seed_not_returned",), ("seed_not_returned",), ("low_score",)], "reject_reason string")
    got = {(r.dimension, r.value): (r.n, r.rate) for r in export.report(accepted, rejected).collect()}
    assert got["accept_tier", "strong"] == (2, None) and got["reject_reason", "seed_not_returned"] == (2, None) and got["pass_rate", "all"] == (4, 4 / 7) and got["vehicle", "m"][0] == 3
    assert export.report(accepted.limit(0), rejected.limit(0)).where("dimension = 'pass_rate'").first().rate is None


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('say {"a": {"b": 2}} and {"c": 3}', '{"a": {"b": 2}}'), ("none", None), ('{"a": 1', None),
        ('{"z": 0} ```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": "}"} x', '{"a": "}"}'), (None, None),
    ],
)
def test_first_object(text, want):
    assert completion.first_object(text) == want


def test_complete(spark):
    def make():
        state = {"n": 0}

        def ask(prompt):
            state["n"] += 1
            if prompt == "bad" or (prompt == "flaky" and state["n"] == 1):
                raise ValueError("no")
            return prompt.upper()

        return ask

    for prompt, want in (("good", ("GOOD", None, 1)), ("bad", (None, "ValueError: no", 3)), ("flaky", ("FLAKY", None, 2))):
        r = completion.complete(spark.createDataFrame([(prompt,)], "prompt string"), make).first()
        assert (r.response, r.error, r.attempts) == want
    def plain_first():
        state = {"n": 0}

        def ask(prompt):
            state["n"] += 1
            return "no idea" if prompt == "never" or state["n"] == 1 else 'well: {"a": "}"} so'

        return ask

    for prompt, want in (("later", ('{"a": "}"}', None, 2)), ("never", (None, "no JSON object in the answer", 3))):
        r = completion.complete_json(spark.createDataFrame([(prompt,)], "prompt string"), plain_first).first()
        assert (r.found, r.error, r.attempts) == want
    rewritten = [completion.clean_rewrite(F.lit(x), F.lit("q")) for x in ("\n what else \nmore", " \n", None)]
    assert tuple(spark.range(1).select(*rewritten).first()) == ("what else", "q", "q")
    shown = completion.render("a {x} b {y}.", x=F.lit(1), y=F.lit(None).cast("string"))
    entry = completion.context(F.lit(1), F.lit("m"), F.lit(None).cast("int"), F.lit("s"), F.lit("t"))
    clean = completion.clean_keyword(F.lit("关键词： tyre, oil\nmore"), F.lit("q"))
    blank = completion.clean_keyword(F.lit("关键词:"), F.lit("q"))
    assert tuple(spark.range(1).select(shown, entry, clean, blank).first()) == ("a 1 b .", "[1] m | s\nt", "tyre, oil", "q")


def test_verify(spark):
    rows = spark.createDataFrame([("a", 0, 0.9, False), ("a", 1, 0.5, True), ("a", 2, 0.7, False), ("b", 0, 0.1, False), ("b", 1, 0.2, False)], "query_id string, pos int, score double, kept boolean")
    assert {(r.query_id, r.pos) for r in corpus_gen.verify_floor(rows, 2).collect()} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    answers = {"是": True, "yes\nno": True, "否": False, "No": False, "应该否": False, "是否": True, "maybe": True, " 无关 ": False}
    got = spark.createDataFrame([(a,) for a in answers], "a string").select("a", corpus_gen.parse_verdict(F.col("a")).alias("v")).collect()
    assert {r.a: r.v for r in got} == answers


def test_route_property(spark):
    rng = random.Random(3)
    aliases = [(f"m{i % 4}", "".join(rng.choices("abc", k=rng.randint(1, 4)))) for i in range(14)]
    texts = ["".join(rng.choices("abcd ", k=rng.randint(0, 14))) for _ in range(400)]

    def plain(text: str) -> list[str]:
        hay, used, out = (text + " ").replace(" ", ""), set(), []
        for model, alias in sorted(aliases, key=lambda x: -len(x[1])):
            if model in out:
                continue
            for at in range(len(hay) - len(alias) + 1):
                span = set(range(at, at + len(alias)))
                if hay[at : at + len(alias)] == alias and not span & used:
                    used |= span
                    out.append(model)
                    break
        return out

    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", routing.route(F.col("t"), F.lit(None).cast("string"), aliases).alias("m")).collect()
    assert all(r.m == plain(r.t) for r in got)
