"""Generation of instruction samples: plan, gates, quality, splits, reports, ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import fingerprint, preview, question_key, sample_id
from quarryline.jobs import tables as t
from quarryline.operators import completion, corpus_gen, export, quality, routing, vectors
from quarryline.sources import corpus
from quarryline.sources.scratch import shared_path, written

#: Rules over words of the driver's texts, as the reference rules are over manuals.
RULES = [(["The", "Le"], "steps"), (["ing", "tion"], "terms"), (["er", "que"], "faults")]
BLACKLIST = ["Of>", "La>", "Token"]
PROMISES, INSURANCE, DANGERS, GUARDS, UNITS = ["worthless", "always", "tionly"], ["token", "stupid"], ["Apache", "License", "clown"], ["Version", "scum"], ["bar", "km", "%", "V", "er"]

_TASK = "CASE WHEN contains(section_path, 'The') OR contains(section_path, 'Le') THEN 'steps' WHEN contains(section_path, 'ing') OR contains(section_path, 'tion') THEN 'terms' WHEN contains(section_path, 'er') OR contains(section_path, 'que') THEN 'faults' ELSE 'plain' END"
BAD = "(contains(section_path, 'Of>') OR contains(section_path, 'La>') OR contains(section_path, 'Token'))"
_QID = "'Q' || substring(sha1(concat_ws('|', vehicle_model, chunk_id, task_type)), 1, 10)"


def _task() -> Column:
    return corpus_gen.task_type(F.col("section_path"), RULES, "plain")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chunks(spark, sf_dir).withColumn("task_type", _task()).withColumn("qid", sample_id(F.col("vehicle_model"), F.col("chunk_id"), F.col("task_type")))


TYPED = f"{t.CHUNKS}, typed0 AS (SELECT *, {_TASK} AS task_type FROM chunks), typed AS (SELECT *, {_QID} AS qid FROM typed0)"


@t.query("usable_chunks", f"WITH {t.CHUNKS} SELECT chunk_id, length({t.sql_strip('text')}) >= 200 AND NOT {BAD} AS usable FROM chunks")
def usable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chunks(spark, sf_dir).select("chunk_id", corpus_gen.usable(F.col("text"), F.col("section_path"), 200, BLACKLIST).alias("usable"))


@t.query("task_types", f"WITH {TYPED} SELECT chunk_id, task_type, qid FROM typed")
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("chunk_id", "task_type", "qid")


_PLAN = f"""{TYPED}, ok AS (SELECT * FROM typed WHERE length({t.sql_strip("text")}) >= 200 AND NOT {BAD}),
rd AS (SELECT *, row_number() OVER (PARTITION BY vehicle_model ORDER BY sha256('7|' || chunk_id)) AS rnd FROM ok),
plan AS (SELECT row_number() OVER (ORDER BY rnd, vehicle_model) AS plan_ord, vehicle_model AS model_id, chunk_id, section_path FROM rd WHERE rnd <= 10 ORDER BY plan_ord LIMIT 150)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.chunks(spark, sf_dir).where(corpus_gen.usable(F.col("text"), F.col("section_path"), 200, BLACKLIST))
    return corpus_gen.sampling_plan(rows, 150, 10, 7)


@t.query("sampling_plan", f"WITH {_PLAN} SELECT plan_ord, model_id, chunk_id, section_path FROM plan")
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@t.query("under_min", f"WITH {_PLAN}, n AS (SELECT vehicle_model AS model_id, count(plan_ord) AS planned FROM (SELECT DISTINCT vehicle_model FROM chunks) LEFT JOIN plan ON model_id = vehicle_model GROUP BY 1) SELECT model_id, planned FROM n WHERE planned < 8")
def under_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = t.chunks(spark, sf_dir).select(F.col("vehicle_model").alias("model_id")).distinct()
    return corpus_gen.under_minimum(_plan(spark, sf_dir), models, 8)


KEY = f"translate(lower(regexp_replace(q, '{t.SPACE}', '', 'g')), '？！，。：；（）', '?!,.:;()')"


@t.query(
    "question_dedup",
    f"""WITH d AS (SELECT doc_id AS plan_ord, string_split(text, chr(10))[1] AS q FROM documents), k AS (SELECT plan_ord, {KEY} AS question_key FROM d),
s AS (SELECT DISTINCT question_key FROM k WHERE plan_ord % 50 = 0 AND plan_ord % 100 = 50)
SELECT plan_ord, md5(question_key) AS question_key, (question_key IN (SELECT question_key FROM s)) OR row_number() OVER (PARTITION BY question_key ORDER BY plan_ord) > 1 AS duplicate FROM k""",
)
def question_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("plan_ord"), F.get(F.split("text", "\n"), F.lit(0)).alias("question"))
    seen = asked.where("plan_ord % 100 = 50").select(question_key(F.col("question")).alias("question_key"))
    return corpus_gen.first_questions(asked, seen).select("plan_ord", F.md5("question_key").alias("question_key"), "duplicate")


@t.query("resume_pending", f"WITH {TYPED} SELECT chunk_id, qid FROM typed WHERE chunk_ord % 5 <> 0 AND chunk_ord % 7 <> 0")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run has left to do after ledgers of the first one were written and read back."""
    rows = _typed(spark, sf_dir)
    done, failed = shared_path(spark, "accepted"), shared_path(spark, "rejected")
    meta = F.struct(F.col("vehicle_model").alias("model_id"), "task_type", F.lit("ok").alias("accept_tier"), F.lit("").alias("gen_question_raw"))
    sample = F.struct(F.lit("i").alias("instruction"), F.lit("q").alias("input"), F.lit("a").alias("output"))
    for part in (0, 1):  # two runs, appended
        corpus.append_ledger(rows.where(f"chunk_ord % 5 = 0 AND chunk_ord % 2 = {part}").select("qid", meta.alias("meta"), sample.alias("sample")), done)
    corpus.append_ledger(rows.where("chunk_ord % 7 = 0").select("qid", F.lit("low_score").alias("reject_reason")), failed)
    return corpus_gen.pending(rows.select("chunk_id", "qid"), corpus.read_ledger(spark, done, corpus.ACCEPTED), corpus.read_ledger(spark, failed, corpus.REJECTED))


_GATE = """docs AS (SELECT doc_id, source, text FROM documents), ret AS (SELECT doc_id, pos, CASE WHEN pos = (doc_id % 4) THEN doc_id ELSE 100000000 + pos END AS cid, ((doc_id * 13 + pos * 29) % 70)::DOUBLE / 100 AS score, 's' || ((doc_id + pos) % 2) AS sec
  FROM (SELECT doc_id, unnest(range(1 + doc_id % 9))::INT AS pos FROM docs)),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM ret),
sig AS (SELECT doc_id, count(*) AS retrieved, max(score) AS max_score, max(CASE WHEN cid = doc_id THEN score END) AS seed_score, max(CASE WHEN cid = doc_id THEN place END) AS seed_rank, count(*) FILTER (sec = 's' || (doc_id % 2)) AS same_section_count FROM rk GROUP BY 1),
lab AS (SELECT sig.*, CASE WHEN quality = 1 THEN 'full' WHEN quality = 0 THEN 'partial' ELSE 'no' END AS label, coalesce(toxic = 1, false) AS conflict FROM sig LEFT JOIN labels USING (doc_id)),
gated AS (SELECT *, CASE WHEN conflict THEN 'evidence_conflict' WHEN seed_rank IS NULL OR seed_rank > 5 THEN 'seed_not_returned' WHEN seed_score < 0.3 THEN 'low_score'
  WHEN label = 'full' AND retrieved >= 2 AND seed_rank <= 3 AND max_score >= 0.45 AND same_section_count >= 2 THEN 'strong' WHEN label = 'full' AND retrieved = 1 AND seed_score >= 0.35 THEN 'single_chunk_full'
  WHEN label = 'full' AND retrieved >= 2 THEN 'ok' WHEN label = 'partial' AND retrieved >= 2 THEN 'partial_ok' WHEN retrieved < 2 THEN 'too_few_chunks' ELSE 'insufficient_evidence' END AS verdict FROM lab)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = F.col("doc_id"), F.col("pos")
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), (d % 9).cast("int"))).alias("pos")).select(
        d.alias("qid"), "pos", F.when(p == d % 4, d).otherwise(100_000_000 + p).alias("chunk_id"), (((d * 13 + p * 29) % 70).cast("double") / 100).alias("score"), F.concat(F.lit("s"), ((d + p) % 2).cast("string")).alias("section_path")
    )


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = t.table(spark, sf_dir, "documents")
    found = _found(spark, sf_dir)
    plan = docs.select(d.alias("qid"), d.alias("chunk_id"), F.concat(F.lit("s"), (d % 2).cast("string")).alias("section_path"))
    judged = t.table(spark, sf_dir, "labels").select(d.alias("qid"), "quality", "toxic")
    rows = corpus_gen.gate_signals(found, plan).join(judged, "qid", "left")
    label = F.when(F.col("quality") == 1, "full").when(F.col("quality") == 0, "partial").otherwise("no")
    return rows.withColumn("verdict", corpus_gen.gate(label, F.coalesce(F.col("toxic") == 1, F.lit(False))))


@t.query("gate_verdicts", f"WITH {_GATE} SELECT doc_id AS qid, retrieved, max_score, seed_score, seed_rank::INT AS seed_rank, same_section_count, verdict FROM gated")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("qid", "retrieved", "max_score", "seed_score", "seed_rank", "same_section_count", "verdict")


@t.query(
    "quota_and_stop",
    f"""WITH RECURSIVE {_GATE}, c AS (SELECT doc_id AS plan_ord, verdict, doc_id % 3 <> 0 AS quality_ok, row_number() OVER (ORDER BY doc_id) AS n FROM gated ORDER BY doc_id LIMIT 600),
r AS (SELECT 0::BIGINT AS n, 0 AS had, 0 AS parts, NULL::BIGINT AS plan_ord, NULL::VARCHAR AS outcome, false AS accepted
  UNION ALL SELECT c.n, had + (CASE WHEN had < 100 AND c.verdict IN ('strong', 'single_chunk_full', 'ok', 'partial_ok') AND quality_ok AND NOT (c.verdict = 'partial_ok' AND parts >= 8) THEN 1 ELSE 0 END),
   parts + (CASE WHEN had < 100 AND c.verdict = 'partial_ok' AND quality_ok AND parts < 8 THEN 1 ELSE 0 END), c.plan_ord,
   CASE WHEN had >= 100 THEN NULL WHEN c.verdict = 'partial_ok' AND parts >= 8 THEN 'partial_quota_full' WHEN c.verdict IN ('strong', 'single_chunk_full', 'ok', 'partial_ok') AND NOT quality_ok THEN 'quality' ELSE c.verdict END,
   had < 100 AND c.verdict IN ('strong', 'single_chunk_full', 'ok', 'partial_ok') AND quality_ok AND NOT (c.verdict = 'partial_ok' AND parts >= 8)
  FROM r JOIN c ON c.n = r.n + 1)
SELECT plan_ord, outcome, accepted FROM r WHERE n > 0""",
)
def quota_and_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gated(spark, sf_dir).select(F.col("qid").alias("plan_ord"), "verdict", (F.col("qid") % 3 != 0).alias("quality_ok"))
    return corpus_gen.quota_and_stop(rows, 100, 0.08, 600).select("plan_ord", "outcome", "accepted")


_NUM = r"(?i)\p{Nd}+(?:\.\p{Nd}+)?" + t.SPACE + "*(?:bar|km|%|V|er)"
UNGROUNDED = rf"""list_filter(list_transform(regexp_extract_all(output, '{_NUM}'), lambda m: regexp_replace(m, '{t.SPACE}', '', 'g')), lambda m: NOT contains(tight, m) AND NOT contains(tight, regexp_extract(m, '^\p{{Nd}}+(?:\.\p{{Nd}}+)?')))"""
_ANSWERS = f"""ans AS (SELECT d.doc_id, left(d.text, 30) AS instruction, substring(d.text, 31) AS output0, coalesce(e.text, '') AS evidence FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1 WHERE d.text IS NOT NULL),
cl AS (SELECT doc_id, instruction, evidence, {t.sql_strip("regexp_replace(regexp_replace(output0, 'the[,.]?', '', 'g'), '" + chr(92) + "[" + chr(92) + "p{Nd}+" + chr(92) + "]', '', 'g')")} AS output FROM ans), an AS (SELECT *, regexp_replace(evidence, '{t.SPACE}', '', 'g') AS tight FROM cl)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as samples: the output is all that follows the instruction, the evidence the whole text of the next document."""
    docs = t.table(spark, sf_dir, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("evidence"))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(after, "doc_id", "left")
    output = quality.strip_leaks(F.expr("substring(text, 31)"), [r"the[,.]?", r"\[\p{Nd}+\]"])
    return rows.select("doc_id", F.left("text", F.lit(30)).alias("instruction"), output.alias("output"), F.coalesce("evidence", F.lit("")).alias("evidence"))


@t.query("leak_strip", f"WITH {_ANSWERS} SELECT doc_id, md5(output) AS output_md5 FROM an")
def leak_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", F.md5("output").alias("output_md5"))


@t.query("ungrounded_numbers", f"WITH {_ANSWERS} SELECT doc_id, array_to_string({UNGROUNDED}, '|') AS numbers FROM an")
def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ungrounded(_answers(spark, sf_dir))


def _ungrounded(answers: DataFrame) -> DataFrame:
    return answers.select("doc_id", F.array_join(quality.ungrounded_numbers(F.col("output"), F.col("evidence"), UNITS), "|").alias("numbers"))


@t.query(
    "quality_gate",
    f"""WITH {_ANSWERS}, q AS (SELECT doc_id, CASE WHEN contains(lower(regexp_replace(instruction, '{t.SPACE}', '', 'g')), 'thatthe') THEN 'vehicle_conflict' WHEN len({UNGROUNDED}) > 0 THEN 'ungrounded_number'
 WHEN len(list_filter(['token', 'stupid'], lambda w: contains(output, w) AND NOT contains(evidence, w))) > 0 THEN 'insurance_warranty_mix'
 WHEN (contains(output, 'Apache') OR contains(output, 'License') OR contains(output, 'clown')) AND NOT (contains(output, 'Version') OR contains(output, 'scum')) THEN 'unsafe_danger_advice'
 WHEN len(list_filter(['worthless', 'always', 'tionly'], lambda w: contains(output, w) AND NOT contains(evidence, w))) > 0 THEN 'over_promise'
 WHEN {t.sql_strip("instruction")} = '' OR output = '' OR doc_id % 29 = 0 THEN 'field_incomplete' WHEN length(output) > coalesce(CASE doc_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 500 END, 800) THEN 'length_out_of_bounds' END AS reason,
 {UNGROUNDED} AS nums, list_filter({PROMISES}, lambda w: contains(output, w) AND NOT contains(evidence, w)) AS words, length(output) AS size FROM an)
SELECT doc_id, reason, CASE reason WHEN 'vehicle_conflict' THEN 'foreign=[''other'']' WHEN 'ungrounded_number' THEN 'nums=[''' || array_to_string(nums, ''', ''') || ''']' WHEN 'over_promise' THEN 'words=[''' || array_to_string(words, ''', ''') || ''']'
 WHEN 'length_out_of_bounds' THEN 'len=' || size ELSE CASE WHEN reason IS NOT NULL THEN '' END END AS detail FROM q""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, _answers(spark, sf_dir))


def _reasons(spark: SparkSession, answers: DataFrame) -> DataFrame:
    most = spark.createDataFrame([(0, 400), (1, 500)], "task long, max_chars int")
    rows = answers.withColumn("task", F.col("doc_id") % 3).join(F.broadcast(most), "task", "left")  # a setting for each task
    foreign = routing.route(F.col("instruction"), F.lit(None).cast("string"), [("other", "that the")])
    question = F.when(F.col("doc_id") % 29 == 0, " \n").otherwise(F.col("instruction"))
    bad = quality.failure(F.col("instruction"), F.col("output"), F.col("evidence"), foreign, F.coalesce("max_chars", F.lit(800)), PROMISES, INSURANCE, DANGERS, GUARDS, UNITS, question)
    return rows.select("doc_id", bad.alias("bad")).select("doc_id", "bad.reason", "bad.detail")


@t.query(
    "verify_floor",
    """WITH r AS (SELECT doc_id, 'q' || (doc_id // 6) AS query_id, doc_id % 6 AS pos, ((doc_id * 37) % 100)::DOUBLE AS score, coalesce(quality = 1, false) AND doc_id % 4 = 0 AS kept FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT *, sum(kept::INT) OVER (PARTITION BY query_id) AS nk, row_number() OVER (PARTITION BY query_id, kept ORDER BY score DESC, pos) AS nth FROM r)
SELECT query_id, doc_id, kept FROM n WHERE kept OR nk = 0 OR nth <= 2 - nk""",
)
def verify_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = t.table(spark, sf_dir, "documents").join(t.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    answer = F.when((F.col("quality") == 1) & (d % 4 == 0), "是\nbecause").otherwise("否")
    judged = rows.select("doc_id", F.concat(F.lit("q"), F.floor(d / 6).cast("string")).alias("query_id"), (d % 6).alias("pos"), ((d * 37) % 100).cast("double").alias("score"), corpus_gen.parse_verdict(answer).alias("kept"))
    return corpus_gen.verify_floor(judged, 2).select("query_id", "doc_id", "kept")


@t.query(
    "train_dev_split",
    f"""WITH {TYPED}, n AS (SELECT chunk_id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY sha256('3|' || qid)) AS nth, count(*) OVER (PARTITION BY task_type) AS n FROM typed)
SELECT chunk_id, task_type, CASE WHEN nth <= round_even(n * 0.9::DOUBLE, 0) THEN 'train' ELSE 'dev' END AS split FROM n""",
)
def train_dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.split(_typed(spark, sf_dir), 0.9, 3).select("chunk_id", "task_type", "split")


_ACCEPT = ["strong", "single_chunk_full", "ok", "partial_ok"]


@t.query(
    "generation_report",
    f"""WITH {TYPED}, {_GATE}, j AS (SELECT typed.*, verdict FROM typed JOIN gated ON doc_id = chunk_ord), a AS (SELECT * FROM j WHERE verdict IN ('strong', 'single_chunk_full', 'ok', 'partial_ok')), r AS (SELECT * FROM j WHERE verdict NOT IN ('strong', 'single_chunk_full', 'ok', 'partial_ok'))
SELECT 'accept_tier' AS dimension, verdict AS value, count(*) AS n, NULL::DOUBLE AS rate FROM a GROUP BY 2 UNION ALL SELECT 'task_type', task_type, count(*), NULL FROM a GROUP BY 2 UNION ALL SELECT 'vehicle', vehicle_model, count(*), NULL FROM a GROUP BY 2
UNION ALL SELECT 'reject_reason', verdict, count(*), NULL FROM r GROUP BY 2 UNION ALL SELECT 'pass_rate', 'all', (SELECT count(*) FROM a), round((SELECT count(*) FROM a)::DOUBLE / (SELECT count(*) FROM j), 6)""",
)
def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is accepted or rejected, by its verdict."""
    rows = _typed(spark, sf_dir).join(_gated(spark, sf_dir).select(F.col("qid").alias("chunk_ord"), "verdict"), "chunk_ord")
    good = F.col("verdict").isin(_ACCEPT)
    accepted = rows.where(good).select(F.col("verdict").alias("accept_tier"), "task_type", F.col("vehicle_model").alias("model_id"))
    rejected = rows.where(~good).select(F.col("verdict").alias("reject_reason"))
    return export.report(accepted, rejected).withColumn("rate", F.round("rate", 6))


@t.query("sample_meta", f"WITH {TYPED} SELECT qid, chunk_id AS seed_chunk_id, md5(substring(replace({t.sql_strip('text')}, chr(10), ' '), 1, 50)) AS seed_preview, substring(sha256(text), 1, 12) AS text_print FROM typed")
def sample_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("qid", F.col("chunk_id").alias("seed_chunk_id"), F.md5(preview(F.col("text"))).alias("seed_preview"), fingerprint(F.col("text")).alias("text_print"))


@t.query("dataset_roundtrip", "SELECT md5(left(text, 20)) AS instruction, md5(substring(text, 21, 40)) AS input, md5(text) AS output FROM documents")
def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as JSON lines and read back."""
    path = shared_path(spark, "dataset")
    corpus.write_dataset(t.table(spark, sf_dir, "documents").select(F.left("text", F.lit(20)).alias("instruction"), F.substring("text", 21, 40).alias("input"), F.col("text").alias("output"), "doc_id"), path)
    return spark.read.schema(corpus.SAMPLE).json(path).select(*[F.md5(c).alias(c) for c in ("instruction", "input", "output")])


@t.query("corpus_roundtrip", f"WITH {t.CHUNKS} SELECT chunk_id, vehicle_model, doc_type, section_path, md5(text) AS text_md5 FROM chunks")
def corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written by model and read back."""
    path = shared_path(spark, "corpus")
    corpus.write_corpus(t.chunks(spark, sf_dir), path)
    kinds = "chunk_id string, chunk_ord long, text string, doc_type string, section_path string, page int, vehicle_model string"
    return spark.read.schema(kinds).parquet(path).select("chunk_id", "vehicle_model", "doc_type", "section_path", F.md5("text").alias("text_md5"))


@t.query(
    "corpus_fingerprint",
    f"""WITH {t.CHUNKS}, s AS (SELECT sha256(chunk_id || '|' || text) AS h FROM chunks), p AS (SELECT count(*) AS n, sum(('0x' || h[1:8])::BIGINT)::VARCHAR AS a, sum(('0x' || h[9:16])::BIGINT)::VARCHAR AS b, sum(('0x' || h[17:24])::BIGINT)::VARCHAR AS c, sum(('0x' || h[25:32])::BIGINT)::VARCHAR AS d FROM s)
SELECT substring(sha256(concat_ws('|', n, a, b, c, d)), 1, 12) AS fingerprint FROM p""",
)
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_fingerprint(t.chunks(spark, sf_dir))


def _stub() -> Callable[[str], str]:
    """A completion function for tests: echoes the prompt's first words as JSON in prose, for even numbers once it is asked again; fails on some prompts, and has no JSON for others."""
    seen: dict[str, int] = {}

    def ask(prompt: str) -> str:
        first = prompt.split("\n")[0]
        seen[first] = seen.get(first, 0) + 1
        if first.startswith("7"):
            raise ValueError("no answer")
        if first.startswith("9") or (int(first.split(" ")[0]) % 2 == 0 and seen[first] == 1):
            return "let me think {"
        return f'Sure: {{"question": "{first[:40]}", "label": "full"}} done'

    return ask


@t.query(
    "parse_responses",
    r"""WITH k AS (SELECT doc_id, lang, starts_with(doc_id::VARCHAR, '7') AS dead, starts_with(doc_id::VARCHAR, '9') AS bare FROM documents)
SELECT doc_id, CASE WHEN NOT dead AND NOT bare THEN doc_id::VARCHAR || ' ' || lang END AS question, CASE WHEN dead OR bare THEN 'no' ELSE 'full' END AS label, (CASE WHEN dead OR bare THEN 3 WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END)::INT AS attempts,
CASE WHEN dead THEN 'ValueError: no answer' WHEN bare THEN 'no JSON object in the answer' END AS error FROM k""",
)
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = t.table(spark, sf_dir, "documents").select("doc_id", completion.render("{id} {lang}\n{text}", id=F.col("doc_id"), lang=F.col("lang"), text=F.col("text")).alias("prompt"))
    # responses are written before use: a replayed task would ask the model again
    asked = written(completion.complete_json(prompts, _stub).drop("prompt", "response"), "responses")
    fields = F.from_json("found", "question string, label string, conflict boolean")
    return asked.withColumn("said", fields).select("doc_id", F.col("said.question").alias("question"), F.coalesce("said.label", F.lit("no")).alias("label"), "attempts", "error")


def _embedder() -> Callable[[list[str]], list[list[float]]]:
    """An embedding function for tests: how often the letters a to d occur."""
    return lambda texts: [[float(x.count(c)) for c in "abcd"] for x in texts]


@t.query("embed_texts", "SELECT doc_id, array_to_string(list_transform(['a', 'b', 'c', 'd'], lambda c: (length(text) - length(replace(text, c, '')))::INT::VARCHAR), ',') AS embedding FROM documents")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.embed(t.table(spark, sf_dir, "documents").select("doc_id", "text"), _embedder)
    return rows.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


@t.query(
    "gate_signals",
    f"""WITH {_GATE} SELECT doc_id AS qid, '{{"seed_rank":' || coalesce(seed_rank, 0)::INT || ',"seed_score":' || coalesce(seed_score, 0.0)::DOUBLE || ',"max_score":' || max_score || ',"same_section_count":' || same_section_count || ',"retrieved":' || retrieved
|| ',"judge_label":"' || label || '","judge_conflict":' || conflict::VARCHAR || '}}' AS signals FROM gated""",
)
def gate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each verdict rests on, as JSON text."""
    rows = _gated(spark, sf_dir)
    label = F.when(F.col("quality") == 1, "full").when(F.col("quality") == 0, "partial").otherwise("no")
    return rows.select("qid", corpus_gen.signals(label, F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("signals"))


POOLS = {"plain": ["Answer.", "Say what the text says."], "steps": ["List the steps.", "How is it done?", "Explain the procedure."], "terms": ["Define it."]}


@t.query(
    "instruction_variants",
    f"""WITH {TYPED}, p AS (SELECT qid, {"CASE task_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in POOLS.items()) + f" ELSE {POOLS['plain']} END"} AS pool FROM typed)
SELECT qid, pool[1 + ('0x' || md5(qid)[1:8])::BIGINT % len(pool)] AS instruction FROM p""",
)
def instruction_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's instruction, from its task's pool; tasks without a pool have that of plain questions."""
    return _typed(spark, sf_dir).select("qid", corpus_gen.instruction(F.col("qid"), F.col("task_type"), POOLS, "plain").alias("instruction"))


@t.query(
    "foreign_models",
    f"""WITH {_ANSWERS}, h AS (SELECT an.doc_id, d.source, lower(regexp_replace(instruction, '{t.SPACE}', '', 'g')) AS i, lower(regexp_replace(an.output, '{t.SPACE}', '', 'g')) AS o FROM an JOIN documents d USING (doc_id))
SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(i, 'tion') THEN 'src1' END, CASE WHEN contains(i, 'ing') THEN 'src3' END, CASE WHEN contains(o, 'tion') THEN 'src1' END, CASE WHEN contains(o, 'ing') THEN 'src3' END], lambda x: x IS NOT NULL AND x <> source), ',') AS others FROM h""",
)
def foreign_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models other than its own that a sample's question or answer names."""
    rows = _answers(spark, sf_dir).join(t.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("doc_id", F.array_join(quality.foreign_models(F.col("instruction"), F.col("output"), F.col("source"), [("src1", "tion"), ("src3", "ing")]), ",").alias("others"))


_FOUND_META = """m AS (SELECT doc_id AS qid, string_agg(cid, ',' ORDER BY place) AS evidence_ids, string_agg(score::VARCHAR, ',' ORDER BY place) AS scores FROM rk GROUP BY 1)"""


@t.query(
    "meta_sidecar",
    f"""WITH {_GATE}, {_FOUND_META} SELECT 'Q' || doc_id AS qid, evidence_ids, scores, coalesce(seed_rank, 0)::INT AS seed_rank, label AS evidence_sufficiency, verdict AS accept_tier, md5(substring(replace({t.sql_strip("docs.text")}, chr(10), ' '), 1, 50)) AS seed_preview
FROM gated JOIN m ON m.qid = doc_id JOIN docs USING (doc_id)""",
)
def meta_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of each sample, lists of evidence in the order of their scores, written and read back."""
    d = F.col("qid")
    gated = _gated(spark, sf_dir)
    own = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "pos", F.col("chunk_id").cast("string").alias("id"), "score")))
    found = _found(spark, sf_dir).groupBy("qid").agg(own.alias("found"))
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "text", "source", "lang")
    label = F.when(F.col("quality") == 1, "full").when(F.col("quality") == 0, "partial").otherwise("no")
    rows = gated.join(found, "qid").join(docs, "qid").select(
        F.concat(F.lit("Q"), d.cast("string")).alias("qid"),
        F.col("source").alias("model_id"),
        F.col("source").alias("model_display"),
        F.col("lang").alias("doc_type"),
        F.lit("").alias("section_path"),
        F.lit("plain").alias("task_type"),
        d.cast("string").alias("seed_chunk_id"),
        preview(F.col("text")).alias("seed_preview"),
        F.coalesce("seed_score", F.lit(0.0)).alias("seed_score"),
        F.transform("found", lambda x: x["id"]).alias("evidence_chunk_ids"),
        F.transform("found", lambda x: F.concat(F.lit("chunk "), x["id"])).alias("evidence_previews"),
        F.transform("found", lambda x: x["score"]).alias("retrieval_scores"),
        "max_score",
        F.coalesce("seed_rank", F.lit(0)).cast("int").alias("seed_rank"),
        "same_section_count",
        label.alias("evidence_sufficiency"),
        F.col("verdict").alias("accept_tier"),
        F.lit("stub").alias("backend"),
        F.lit("").alias("gen_question_raw"),
    )
    path = shared_path(spark, "meta")
    corpus.write_meta(rows, path)
    back = spark.read.schema(corpus.META_FIELDS).json(path)
    return back.select("qid", F.array_join("evidence_chunk_ids", ",").alias("evidence_ids"), F.array_join(F.col("retrieval_scores").cast("array<string>"), ",").alias("scores"), "seed_rank", "evidence_sufficiency", "accept_tier", F.md5("seed_preview").alias("seed_preview"))
