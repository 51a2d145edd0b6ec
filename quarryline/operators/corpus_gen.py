"""Instruction samples from chunks: which chunks, which questions, what is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import question_key, shuffle_key, strip

#: Words of a section, in order, that decide the task; the first rule that matches wins.
TASK_RULES = [
    (["故障", "警示", "报警", "异常", "警告灯", "提示灯"], "故障分析"),
    (["名词", "定义", "简介", "术语", "缩略", "释义"], "术语解释"),
    (["检查", "保养", "操作", "更换", "安装", "加注", "清洗", "调节"], "步骤指导"),
    (["安全", "儿童", "安全带", "气囊", "乘员", "警告"], "安全提醒"),
]
DEFAULT_TASK = "直接问答"
#: Sections that give no samples.
BLACKLIST = ["前言", "目录", "免责声明", "版权", "隐私", "单位", "术语", "缩略语", "修订记录", "联系方式"]


def holds_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def task_type(section: Column, rules: list[tuple[list[str], str]] | None = None, default: str = DEFAULT_TASK) -> Column:
    out = F.lit(default)
    for words, task in reversed(TASK_RULES if rules is None else rules):
        out = F.when(holds_any(section, words), task).otherwise(out)
    return out


def usable(text: Column, section: Column, min_chars: int = 200, blacklist: list[str] | None = None) -> Column:
    return (F.length(strip(text)) >= min_chars) & ~holds_any(section, BLACKLIST if blacklist is None else blacklist)


def sampling_plan(chunks: DataFrame, target: int, per_model_max: int = 10, seed: int | str = 0) -> DataFrame:
    """``plan_ord, model_id, chunk_id, section_path``: chunks of each model in a seeded order, at most ``per_model_max``, dealt in rounds over the models
    in the order of their names until ``target``. A model's list is cut before models meet, so the last step sorts few rows."""
    own = Window.partitionBy("vehicle_model").orderBy(shuffle_key(seed, F.col("chunk_id")))
    few = chunks.withColumn("round", F.row_number().over(own)).where(F.col("round") <= per_model_max)
    top = few.orderBy("round", "vehicle_model").limit(target)
    return top.withColumn("plan_ord", F.row_number().over(Window.orderBy("round", "vehicle_model")).cast("long")).select("plan_ord", F.col("vehicle_model").alias("model_id"), "chunk_id", "section_path")


def under_minimum(plan: DataFrame, models: DataFrame, least: int = 3) -> DataFrame:
    """``model_id, planned`` of models planned less often than ``least``, never included."""
    counted = plan.groupBy("model_id").agg(F.count(F.lit(1)).alias("planned"))
    return models.select("model_id").join(counted, "model_id", "left").fillna(0, ["planned"]).where(F.col("planned") < least)


def first_questions(questions: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Adds ``question_key`` and ``duplicate``: whether an earlier row of the plan, or ``seen`` (``question_key``), has the same key. The least place of each key is
    found by a partial aggregate, so a question that very many ask doesn't gather in one task."""
    keyed = questions.withColumn("question_key", question_key(F.col("question")))
    first = keyed.groupBy("question_key").agg(F.min("plan_ord").alias("first_ord"))
    if seen is not None:
        first = first.join(seen.select("question_key").distinct().withColumn("before", F.lit(True)), "question_key", "left")
    else:
        first = first.withColumn("before", F.lit(None).cast("boolean"))
    return keyed.join(first, "question_key").withColumn("duplicate", F.coalesce("before", F.lit(False)) | (F.col("plan_ord") > F.col("first_ord"))).drop("first_ord", "before")


def pending(plan: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Items of the plan in neither ledger."""
    return plan.join(accepted.select("qid").unionByName(rejected.select("qid")), "qid", "left_anti")


def gate_signals(retrieved: DataFrame, plan: DataFrame) -> DataFrame:
    """``qid, retrieved, max_score, seed_score, seed_rank, same_section_count`` from ``retrieved`` (``qid, pos, chunk_id, score, section_path``) and the plan's seeds."""
    own = Window.partitionBy("qid").orderBy(F.col("score").desc(), "pos")
    ranked = retrieved.withColumn("place", F.row_number().over(own)).join(plan.select("qid", F.col("chunk_id").alias("seed"), F.col("section_path").alias("seed_section")), "qid")
    is_seed = F.col("chunk_id") == F.col("seed")
    return ranked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.max("score").alias("max_score"),
        F.max(F.when(is_seed, F.col("score"))).alias("seed_score"),
        F.max(F.when(is_seed, F.col("place"))).alias("seed_rank"),
        F.count_if(F.col("section_path") == F.col("seed_section")).alias("same_section_count"),
    )


def gate(label: Column, conflict: Column, min_retrieved: int = 2, seed_min: float = 0.30, seed_min_single: float = 0.35, strong_rank: int = 3, strong_max: float = 0.45, strong_section: int = 2, topk: int = 5) -> Column:
    """The verdict, the first that applies; ``partial_ok`` is subject to the quota. A seed below the first ``topk`` counts as not returned. Reads the columns of
    ``gate_signals``."""
    n, seed, rank = F.col("retrieved"), F.col("seed_score"), F.col("seed_rank")
    strong = (n >= min_retrieved) & (rank <= strong_rank) & (F.col("max_score") >= strong_max) & (F.col("same_section_count") >= strong_section)
    return (
        F.when(conflict, "evidence_conflict")
        .when(rank.isNull() | (rank > topk), "seed_not_returned")
        .when(seed < seed_min, "low_score")
        .when((label == "full") & strong, "strong")
        .when((label == "full") & (n == 1) & (seed >= seed_min_single), "single_chunk_full")
        .when((label == "full") & (n >= min_retrieved), "ok")
        .when((label == "partial") & (n >= min_retrieved), "partial_ok")
        .when(n < min_retrieved, "too_few_chunks")
        .otherwise("insufficient_evidence")
    )


def signals(label: Column, conflict: Column) -> Column:
    """What a verdict rests on, as JSON text; a seed that wasn't returned has rank and score 0. Reads the columns of ``gate_signals``."""
    none = lambda c, zero: F.coalesce(F.col(c), F.lit(zero)).alias(c)
    parts = [none("seed_rank", 0), none("seed_score", 0.0), none("max_score", 0.0), none("same_section_count", 0), none("retrieved", 0)]
    return F.to_json(F.struct(*parts, label.alias("judge_label"), conflict.alias("judge_conflict")))


def instruction(qid: Column, task: Column, pools: dict[str, list[str]], default: str) -> Column:
    """A variant of the task's instruction by a hash of the sample's id; an unknown task has the ``default`` task's pool."""
    pick = lambda pool: F.element_at(F.lit(pool), 1 + (F.conv(F.substring(F.md5(qid), 1, 8), 16, 10).cast("long") % len(pool)).cast("int"))
    out = pick(pools[default])
    for name, pool in pools.items():
        out = F.when(task == name, pick(pool)).otherwise(out)
    return out


ACCEPTED = ["strong", "single_chunk_full", "ok", "partial_ok"]


def quota_and_stop(candidates: DataFrame, target: int, partial_share: float = 0.08, max_attempts: int = 400, prior_accepted: int = 0, prior_partial: int = 0) -> DataFrame:
    """Adds ``outcome`` to ``plan_ord, verdict, quality_ok``: the verdict, ``partial_quota_full``, ``quality`` or null (never tried).

    A partial is accepted while fewer than floor(share * target) partials before it passed; attempts end once ``target`` are accepted or after ``max_attempts``. Both are
    running counts over the plan's order. The order is global, and of a run of at most some thousand attempts: rows past ``max_attempts`` are cut first.
    """
    quota = int(partial_share * target)
    tried = candidates.orderBy("plan_ord").limit(max_attempts)
    own = Window.orderBy("plan_ord")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    partial = (F.col("verdict") == "partial_ok") & F.col("quality_ok")
    rows = tried.withColumn("partials", F.coalesce(F.sum(F.when(partial, 1).otherwise(0)).over(before), F.lit(0)) + prior_partial)
    full = (F.col("verdict") == "partial_ok") & (F.col("partials") >= quota)
    accepted = F.col("verdict").isin(ACCEPTED) & F.col("quality_ok") & ~full
    outcome = F.when(full, "partial_quota_full").when(F.col("verdict").isin(ACCEPTED) & ~F.col("quality_ok"), "quality").otherwise(F.col("verdict"))
    rows = rows.withColumn("outcome", outcome).withColumn("accepted", accepted)
    rows = rows.withColumn("had", F.coalesce(F.sum(F.when(F.col("accepted"), 1).otherwise(0)).over(before), F.lit(0)) + prior_accepted)
    return rows.withColumn("live", F.col("had") < target).select(*[c for c in candidates.columns if c not in ("outcome", "accepted")], F.when(F.col("live"), F.col("outcome")).alias("outcome"), (F.col("accepted") & F.col("live")).alias("accepted"))


def verify_floor(judged: DataFrame, min_keep: int) -> DataFrame:
    """Of ``query_id, pos, score, kept``: the kept rows; all if none was kept; the best of the others where fewer than ``min_keep`` were."""
    query = Window.partitionBy("query_id")
    rest = Window.partitionBy("query_id", "kept").orderBy(F.col("score").desc(), "pos")
    rows = judged.withColumns({"n_kept": F.sum(F.col("kept").cast("int")).over(query), "nth": F.row_number().over(rest)})
    return rows.where(F.col("kept") | (F.col("n_kept") == 0) | (F.col("nth") <= F.lit(min_keep) - F.col("n_kept"))).drop("n_kept", "nth")


def parse_verdict(response: Column) -> Column:
    """Whether the first line of a verifier's answer says yes; unclear answers keep the row."""
    first = strip(F.get(F.split(strip(response), "\n"), F.lit(0)))
    return F.when(first.isin("是", "yes", "Yes", "YES", "相关"), True).when(first.isin("否", "no", "No", "NO", "无关"), False).when(F.contains(first, F.lit("否")) & ~F.contains(first, F.lit("是")), False).otherwise(True)
