"""Generation of instruction samples as one resumable job.

The job runs in waves over the plan. A wave takes the next items that no ledger has, asks for their questions, drops those asked before, retrieves their evidence, has it
judged, decides by the signals, asks for answers and checks them; then it commits its rows to the ledger, and the next wave begins. What a model answers is
written before it is used, in the wave's own folder: a wave that was cut off is run again from what it had written whole, and only a stage that was cut off in the middle asks
its model again. Quota, target and
questions asked before carry over from all committed waves, as if the plan had been gone through item by item; attempts count anew in each run.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import preview, question_key, sample_id, strip
from quarryline.operators import corpus_gen, export, quality
from quarryline.operators.completion import complete_json, render
from quarryline.sources import corpus
from quarryline.sources.scratch import done, once, written

__all__ = ["LEDGER", "Models", "Settings", "accepted", "generate", "ledger", "plan", "rejected", "replace"]
Model = Callable[[], Callable[[str], str]]
LEDGER = (
    "qid string, model_id string, section_path string, task_type string, seed_chunk_id string, seed_preview string, accepted boolean, reject_stage string, reject_reason string, "
    f"reject_detail string, question string, meta struct<{corpus.META_FIELDS.replace(' ', ':').replace(',:', ',')}>, sample struct<{corpus.SAMPLE.replace(' ', ':').replace(',:', ',')}>"
)


@dataclass(frozen=True)
class Models:
    """What is asked, and by which prompts: ``question`` of ``{model} {section} {text} {task} {chunk_id}``, ``judge`` of ``{question} {evidence}``, ``answer`` of ``{model} {instruction} {question}
    {evidence} {task}``. Answers hold a JSON object: ``question``; ``label`` and ``conflict``; ``output``."""

    question: Model
    judge: Model
    answer: Model
    question_prompt: str
    judge_prompt: str
    answer_prompt: str
    name: str = ""


@dataclass(frozen=True)
class Settings:
    """Sizes and thresholds of the job. ``wave``: items of a wave."""

    target: int = 100
    oversample: float = 2.5
    per_model_max: int = 10
    max_attempts: int = 400
    wave: int = 100
    retries: int = 2
    partial_share: float = 0.08
    min_chars: int = 200
    blacklist: list[str] | None = None
    task_rules: list[tuple[list[str], str]] | None = None
    default_task: str = corpus_gen.DEFAULT_TASK
    pools: dict[str, list[str]] = field(default_factory=dict)
    max_chars: dict[str, int] = field(default_factory=dict)
    default_max_chars: int = 800
    leaks: list[str] | None = None
    rules: dict[str, list[str]] = field(default_factory=dict)
    aliases: list[tuple[str, str]] = field(default_factory=list)
    seed: int | str = 0


def plan(chunks: DataFrame, settings: Settings) -> DataFrame:
    """The items in order, with their seeds: ``plan_ord, qid, model_id, chunk_id, section_path, task_type, doc_type, text``."""
    s = settings
    usable = chunks.where(corpus_gen.usable(F.col("text"), F.col("section_path"), s.min_chars, s.blacklist))
    chosen = corpus_gen.sampling_plan(usable, math.ceil(s.target * s.oversample), s.per_model_max, s.seed)
    typed = chosen.withColumn("task_type", corpus_gen.task_type(F.col("section_path"), s.task_rules, s.default_task))
    typed = typed.withColumn("qid", sample_id(F.col("model_id"), F.col("chunk_id"), F.col("task_type")))
    return typed.join(chunks.select("chunk_id", "doc_type", "text"), "chunk_id")


def ledger(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The rows of all committed waves, and how many waves there are."""
    waves: list[str] = []
    while done(spark, at := f"{path}/ledger/wave-{len(waves):06d}"):
        waves.append(at)
    return (spark.read.schema(LEDGER).json(waves) if waves else spark.createDataFrame([], LEDGER)), len(waves)


def _field(found: str, name: str, kind: str = "string") -> Column:
    return F.from_json(F.col(found), f"{name} {kind}")[name]


def _wave(items: DataFrame, seen: DataFrame, chunks: DataFrame, retrieve: Callable[[DataFrame], DataFrame], models: Models, settings: Settings, at: str) -> DataFrame:
    """Every item with what became of it: ``verdict`` (what it failed before answers, or the gate's), ``quality_ok``, and the parts of its record."""
    s = settings
    prompt = render(models.question_prompt, model=F.col("display"), section=F.col("section_path"), text=F.col("text"), task=F.col("task_type"), chunk_id=F.col("chunk_id"))
    asked = once(complete_json(items.withColumn("prompt", prompt), models.question, retries=s.retries).drop("prompt", "response", "attempts"), f"{at}/questions")
    asked = asked.withColumn("question", F.coalesce(strip(_field("found", "question")), F.lit("")))
    asked = asked.withColumn("failed", F.when(F.col("error").isNotNull(), "json_parse_failed").when(F.col("question") == "", "missing_required_field"))
    keyed = corpus_gen.first_questions(asked.where("failed IS NULL"), seen)
    fresh = written(keyed.where("NOT duplicate").drop("question_key", "duplicate"), "fresh")
    found = once(retrieve(fresh.select(F.col("qid").alias("query_id"), "question", "model_id", "chunk_id")).select(F.col("query_id").alias("qid"), F.col("position").alias("pos"), "chunk_id", "score"), f"{at}/retrieved")
    shown = found.join(chunks.select("chunk_id", "section_path", F.col("text").alias("body")), "chunk_id").withColumn("body", strip(F.col("body")))
    evidence = shown.groupBy("qid").agg(
        F.array_join(export.ordered("pos", "body"), "\n").alias("evidence"),
        export.ordered("pos", "chunk_id").alias("evidence_chunk_ids"),
        F.transform(export.ordered("pos", "body"), preview).alias("evidence_previews"),
        export.ordered("pos", "score").alias("retrieval_scores"),
    )
    rows = fresh.drop("error", "failed").join(evidence, "qid", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    prompt = render(models.judge_prompt, question=F.col("question"), evidence=F.col("evidence"))
    judged = once(complete_json(rows.withColumnRenamed("found", "raw").withColumn("prompt", prompt), models.judge, retries=s.retries).drop("prompt", "response", "attempts"), f"{at}/judged")
    judged = judged.withColumns({"label": F.coalesce(_field("found", "label"), F.lit("no")), "conflict": F.coalesce(_field("found", "conflict", "boolean"), F.lit(False))}).drop("found", "error")
    signals = corpus_gen.gate_signals(shown, items.select("qid", "chunk_id", "section_path"))
    gated = judged.join(signals, "qid", "left").withColumns({"retrieved": F.coalesce("retrieved", F.lit(0)), "max_score": F.coalesce("max_score", F.lit(0.0))})
    gated = gated.withColumns({"verdict": corpus_gen.gate(F.col("label"), F.col("conflict")), "signals": corpus_gen.signals(F.col("label"), F.col("conflict"))})
    gated = gated.withColumn("instruction", corpus_gen.instruction(F.col("qid"), F.col("task_type"), s.pools, s.default_task))
    prompt = render(models.answer_prompt, model=F.col("display"), instruction=F.col("instruction"), question=F.col("question"), evidence=F.col("evidence"), task=F.col("task_type"))
    good = gated.where(F.col("verdict").isin(corpus_gen.ACCEPTED)).select("qid", "model_id", "task_type", "instruction", "question", "evidence", prompt.alias("prompt"))
    answered = once(complete_json(good, models.answer, retries=s.retries).drop("prompt", "response", "attempts"), f"{at}/answers")
    most = F.lit(s.default_max_chars)
    for task, n in s.max_chars.items():
        most = F.when(F.col("task_type") == task, n).otherwise(most)
    answered = answered.withColumn("output", quality.strip_leaks(F.coalesce(_field("found", "output"), F.lit("")), s.leaks))
    foreign = quality.foreign_models(F.col("question"), F.col("output"), F.col("model_id"), s.aliases)
    answered = answered.withColumn("bad", F.when(F.col("error").isNull(), quality.failure(F.col("instruction"), F.col("output"), F.col("evidence"), foreign, most, question=F.col("question"), **s.rules)))
    answered = answered.select("qid", "output", F.col("error").alias("answer_error"), "bad")
    parts = gated.select("qid", "raw", "evidence_chunk_ids", "evidence_previews", "retrieval_scores", "label", "retrieved", "max_score", "seed_score", "seed_rank", "same_section_count", "verdict", "signals", "instruction")
    all_ = asked.join(keyed.select("qid", "duplicate"), "qid", "left").join(parts, "qid", "left").join(answered, "qid", "left")
    return all_.withColumns(
        {
            "gate": F.col("verdict"),
            "verdict": F.coalesce("failed", F.when(F.col("duplicate"), "duplicate"), "verdict"),
            "quality_ok": F.col("answer_error").isNull() & F.col("bad").isNull(),
        }
    )


def _records(rows: DataFrame, name: str) -> DataFrame:
    """The rows of ``LEDGER``, from decided ones."""
    early = F.col("failed").isNotNull() | F.coalesce("duplicate", F.lit(False))
    broken = (F.col("outcome") == "quality") & F.col("answer_error").isNotNull()
    stage = F.when(F.col("accepted"), "").when(early | broken, "generation").when(F.col("outcome") == "quality", "quality").otherwise("answerability")
    reason = F.when(F.col("accepted"), "").when(broken, "json_parse_failed").when(F.col("outcome") == "quality", F.col("bad.reason")).otherwise(F.col("outcome"))
    detail = F.when(stage == "answerability", F.col("signals")).when(broken, F.col("answer_error")).when(stage == "quality", F.col("bad.detail")).when(F.col("failed").isNotNull(), F.col("error"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    seed = [F.col("chunk_id").alias("seed_chunk_id"), preview(F.col("text")).alias("seed_preview")]
    meta = F.struct(
        "qid", "model_id", F.col("display").alias("model_display"), "doc_type", "section_path", "task_type", *seed, zero("seed_score", 0.0), "evidence_chunk_ids", "evidence_previews", "retrieval_scores", zero("max_score", 0.0),
        zero("seed_rank", 0), zero("same_section_count", 0), F.col("label").alias("evidence_sufficiency"), F.col("outcome").alias("accept_tier"), F.lit(name).alias("backend"), F.col("raw").alias("gen_question_raw"),
    )
    sample = F.struct("instruction", F.col("question").alias("input"), "output")
    own = [F.when(F.col("accepted"), x) for x in (meta, sample)]
    return rows.select("qid", "model_id", "section_path", "task_type", *seed, "accepted", stage.alias("reject_stage"), reason.alias("reject_reason"), F.coalesce(detail, F.lit("")).alias("reject_detail"), "question", own[0].alias("meta"), own[1].alias("sample"))


def generate(chunks: DataFrame, retrieve: Callable[[DataFrame], DataFrame], models: Models, path: str, settings: Settings | None = None, names: DataFrame | None = None) -> DataFrame:
    """The ledger (``LEDGER``) below ``path`` after the plan is used up, ``target`` samples are accepted or ``max_attempts`` items were tried in this run.

    ``chunks``: ``chunk_id, text, vehicle_model, doc_type, section_path``. ``retrieve`` gives ``query_id, position, chunk_id, score`` for ``query_id, question, model_id, chunk_id`` (the seed). ``names``: ``model_id, name`` for display.
    """
    s = settings or Settings()
    spark = chunks.sparkSession
    items = plan(chunks, s)
    shown = F.col("model_id") if names is None else F.coalesce("name", "model_id")
    items = written((items if names is None else items.join(F.broadcast(names), "model_id", "left")).withColumn("display", shown).drop("name"), "plan")  # names: a row for each model
    attempts = 0
    while True:
        sofar, n = ledger(spark, path)
        had = sofar.agg(F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & (F.col("meta.accept_tier") == "partial_ok")).alias("partial")).first()
        left = min(s.wave, s.max_attempts - attempts)
        if had.accepted >= s.target or left <= 0:
            return sofar
        at = f"{path}/work/wave-{n:06d}"
        now = once(items.join(sofar.select("qid"), "qid", "left_anti").orderBy("plan_ord").limit(left), f"{at}/items")
        size = now.count()
        if not size:
            return sofar
        seen = sofar.where("question <> ''").select(question_key(F.col("question")).alias("question_key"))
        rows = written(_wave(now, seen, chunks, retrieve, models, s, at), "wave")
        decided = corpus_gen.quota_and_stop(rows, s.target, s.partial_share, size, had.accepted, had.partial).where("outcome IS NOT NULL")
        _records(decided, models.name).coalesce(1).write.mode("overwrite").json(f"{path}/ledger/wave-{n:06d}")  # of a wave's rows
        attempts += size


def accepted(rows: DataFrame) -> DataFrame:
    """``qid, meta, sample`` of the ledger's accepted samples."""
    return rows.where("accepted").select("qid", "meta", "sample")


def rejected(rows: DataFrame) -> DataFrame:
    """The ledger's rejected items, as ``sources.corpus.write_rejected`` writes them."""
    return rows.where("NOT accepted").select(*[f.split(" ")[0] for f in corpus.REJECTED.split(", ")])
