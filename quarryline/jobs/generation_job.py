"""The generation of samples as one job, over all chunks of the driver's texts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.jobs import generation_queries as g
from quarryline.jobs import tables as t
from quarryline.jobs.retrieval_queries import LISTS
from quarryline.operators import bm25, generation, retrieval
from quarryline.sources.scratch import shared_path, written

JOB = generation.Settings(
    target=40, per_model_max=10, wave=60, retries=1, partial_share=0.2, blacklist=g.BLACKLIST, task_rules=g.RULES, default_task="plain", pools=g.POOLS, max_chars={"steps": 90}, leaks=[r"the[,.]?", r"\[\p{Nd}+\]"],
    rules={"promises": g.PROMISES, "insurance": g.INSURANCE, "dangers": g.DANGERS, "guards": g.GUARDS, "units": g.UNITS}, aliases=[("src1", "thatthe"), ("src3", "delas")], seed=7,
)


def _models() -> generation.Models:
    """Completion functions for tests, by the ids and lengths of what they read: some answers have no JSON, at first or ever."""

    def question() -> Callable[[str], str]:
        seen: dict[str, int] = {}

        def ask(prompt: str) -> str:
            n, text = prompt.split("\n", 1)
            seen[n] = seen.get(n, 0) + 1
            if int(n) % 13 == 0 or (int(n) % 5 == 0 and seen[n] == 1):
                return "nothing comes to mind"
            return "Sure: " + json.dumps({"question": " " if int(n) % 17 == 0 else "The same again?" if int(n) % 7 == 0 else text.replace("\n", " ")[:60]})

        return ask

    def judge() -> Callable[[str], str]:
        def ask(prompt: str) -> str:
            n = len(prompt.split("\n")[0])
            return json.dumps({"label": "no" if n % 8 == 0 else "partial" if n % 3 == 1 else "full", "conflict": n % 19 == 0})

        return ask

    def answer() -> Callable[[str], str]:
        def ask(prompt: str) -> str:
            evidence = prompt.split("\n", 1)[1]
            n = len(evidence)
            return "{no" if n % 11 == 0 else json.dumps({"output": "" if n % 6 == 1 else evidence[:80] + (" 77 bar" if n % 6 == 0 else "")})

        return ask

    return generation.Models(question, judge, answer, "{chunk_id}\n{text}", "{question}\n{evidence}", "{question}\n{evidence}", "rules")


def _generate(spark: SparkSession, sf_dir: str, path: str, wave: int, dies_at: int | None = None) -> DataFrame:
    """The job over all chunks; evidence comes from the whole retrieval job, for the item's own model. A question's vector is its seed's."""
    rows, vecs = t.chunks(spark, sf_dir), t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    # beside the ledger: a run that goes on reads the index of the one before
    folder = f"{path}-bm25"
    there = bm25.exists(spark, folder)
    if not there:
        bm25.write_index(rows, folder)
    index = bm25.with_facts(bm25.read_index(spark, folder, rows if there else None), rows)
    vectors = written(t.corpus_vectors(spark, sf_dir), "corpus-vectors")
    calls = {"n": 0}

    def find(asked: DataFrame) -> DataFrame:
        calls["n"] += 1
        if calls["n"] == dies_at:
            raise RuntimeError("the run ends here")
        words = F.array_join(F.filter(tokens(F.col("question")), lambda x: F.length(x) >= 6), ",")
        none = F.lit(None).cast("array<float>")
        full = asked.join(vecs, "chunk_id", "left").select("query_id", "question", F.col("question").alias("rewritten"), words.alias("keyword"), F.array("model_id").alias("models"), F.col("embedding").alias("rewritten_vector"), none.alias("keyword_vector"))
        trace = retrieval.retrieve(written(full, "asked"), rows, vectors, index=index)
        return trace.where("stage = 'final'").select("query_id", "position", "chunk_id", F.round("score", 9).alias("score"))

    return generation.generate(rows, find, _models(), path, replace(JOB, wave=wave))


def _shown(rows: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "qid",
        "model_id",
        "task_type",
        "seed_chunk_id",
        "accepted",
        "reject_stage",
        "reject_reason",
        F.when(F.col("reject_stage") == "quality", F.col("reject_detail")).otherwise("").alias("quality_detail"),
        F.md5("question").alias("question"),
        empty(F.col("meta.accept_tier")).alias("tier"),
        empty(F.col("sample.instruction")).alias("instruction"),
        F.md5(empty(F.col("sample.output"))).alias("output"),
        empty(F.array_join("meta.evidence_chunk_ids", ",")).alias("evidence_ids"),
        F.coalesce("meta.seed_rank", F.lit(0)).alias("seed_rank"),
    )


_WORDS = lambda ws: ", ".join(f"'{w}'" for w in ws)
_HAS = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_CUT = r"regexp_replace(regexp_replace(raw_output, 'the[,.]?', '', 'g'), '\[\p{Nd}+\]', '', 'g')"
_FOREIGN = ", ".join(f"CASE WHEN contains({c}, '{a}') THEN '{m}' END" for c in ("qk", "ak") for m, a in JOB.aliases)
_POOL = "CASE task_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in g.POOLS.items()) + f" ELSE {g.POOLS['plain']} END"
_GOOD = "('strong', 'single_chunk_full', 'ok', 'partial_ok')"
_SQL = f"""WITH RECURSIVE {g.TYPED}, ok AS (SELECT * FROM typed WHERE length({t.sql_strip("text")}) >= 200 AND NOT {g.BAD}),
rd AS (SELECT *, row_number() OVER (PARTITION BY vehicle_model ORDER BY sha256('7|' || chunk_id)) AS rnd FROM ok),
plan AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rnd, vehicle_model) AS plan_ord, vehicle_model AS model_id, chunk_id, chunk_ord, section_path, task_type, qid, text FROM rd WHERE rnd <= 10 ORDER BY plan_ord LIMIT 100),
q0 AS (SELECT *, chunk_ord % 13 = 0 AS broken, CASE WHEN chunk_ord % 17 = 0 OR chunk_ord % 13 = 0 THEN '' WHEN chunk_ord % 7 = 0 THEN 'The same again?' ELSE {t.sql_strip("left(replace(text, chr(10), ' '), 60)")} END AS q FROM plan),
q1 AS MATERIALIZED (SELECT *, q AS question, q <> '' AND row_number() OVER (PARTITION BY {g.KEY} ORDER BY plan_ord) > 1 AS dup FROM q0),
questions AS MATERIALIZED (SELECT qid AS query_id, question, model_id, chunk_id AS seed FROM q1 WHERE question <> '' AND NOT dup),
{t.BM25},
aims AS (SELECT query_id, model_id AS target, 0 AS no FROM questions),
cv AS (SELECT vec_id::VARCHAR AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings JOIN chunks ON chunk_id = vec_id::VARCHAR),
sims AS (SELECT query_id, chunk_id, round(list_dot_product(s.embedding::DOUBLE[], cv.e), 9) AS score FROM questions JOIN embeddings s ON s.vec_id::VARCHAR = seed CROSS JOIN cv),
vtop AS MATERIALIZED (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 60),
kq AS (SELECT query_id, array_to_string(list_filter({t.TOKENS.format("question")}, lambda x: length(x) >= 6), ',') AS keyword FROM questions),
kasked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({t.TOKENS.format("keyword")}) AS term FROM kq) GROUP BY ALL),
kbm AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dls)))) AS score FROM post JOIN kasked USING (term) JOIN idfs USING (term) JOIN dls USING (chunk_id) GROUP BY ALL),
kvtop AS (SELECT * FROM vtop WHERE false),
{LISTS.format("r", "vtop", "bm", 0.6, 0.4, 5)}, {LISTS.format("k", "kvtop", "kbm", 0.4, 0.6, 2)},
kboost AS (SELECT kf.query_id, no, chunk_id, rank, score * CASE WHEN len(list_filter(string_split(keyword, ','), lambda w: length(w) >= 2 AND contains(lower(section_path), w))) > 0 THEN 1.1 ELSE 1 END AS score FROM kf JOIN chunks USING (chunk_id) JOIN kq USING (query_id)),
kp AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS rank FROM kboost),
ml AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY path_no, rank) AS nth FROM (SELECT query_id, chunk_id, score, rank, 0 AS path_no FROM rf UNION ALL SELECT query_id, chunk_id, score, rank, 1 FROM kp)),
mr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY path_no, rank) AS rank FROM ml WHERE nth = 1),
kept AS (SELECT mr.query_id, chunk_id, mr.rank, coalesce(rv.score, mr.score) AS score FROM mr LEFT JOIN rv USING (query_id, chunk_id) WHERE mr.rank <= 7 AND NOT coalesce(rv.score < 0.2, false)),
found AS MATERIALIZED (SELECT query_id AS qid, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos, section_path, {t.sql_strip("text")} AS body FROM kept JOIN chunks USING (chunk_id)),
ev AS (SELECT qid, string_agg(body, chr(10) ORDER BY pos) AS evidence, string_agg(chunk_id, ',' ORDER BY pos) AS ids, count(*) AS retrieved, max(score) AS max_score FROM found GROUP BY 1),
rk AS (SELECT found.*, q1.chunk_id = found.chunk_id AS own, q1.section_path = found.section_path AS same, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS place FROM found JOIN q1 USING (qid)),
sig AS (SELECT qid, max(CASE WHEN own THEN score END) AS seed_score, max(CASE WHEN own THEN place END) AS seed_rank, count(*) FILTER (same) AS same_section_count FROM rk GROUP BY 1),
g0 AS (SELECT q1.*, coalesce(evidence, '') AS evidence, ids, coalesce(retrieved, 0) AS retrieved, max_score, seed_score, seed_rank, same_section_count, length(question) AS n,
  CASE WHEN length(question) % 8 = 0 THEN 'no' WHEN length(question) % 3 = 1 THEN 'partial' ELSE 'full' END AS label FROM q1 LEFT JOIN ev USING (qid) LEFT JOIN sig USING (qid)),
g1 AS (SELECT *, CASE WHEN broken THEN 'json_parse_failed' WHEN question = '' THEN 'missing_required_field' WHEN dup THEN 'duplicate' WHEN n % 19 = 0 THEN 'evidence_conflict' WHEN seed_rank IS NULL OR seed_rank > 5 THEN 'seed_not_returned' WHEN seed_score < 0.3 THEN 'low_score'
  WHEN label = 'full' AND retrieved >= 2 AND seed_rank <= 3 AND max_score >= 0.45 AND same_section_count >= 2 THEN 'strong' WHEN label = 'full' AND retrieved = 1 AND seed_score >= 0.35 THEN 'single_chunk_full' WHEN label = 'full' AND retrieved >= 2 THEN 'ok'
  WHEN label = 'partial' AND retrieved >= 2 THEN 'partial_ok' WHEN retrieved < 2 THEN 'too_few_chunks' ELSE 'insufficient_evidence' END AS verdict, length(evidence) AS m FROM g0),
o0 AS (SELECT *, m % 11 = 0 AS broken_answer, CASE WHEN m % 6 = 1 THEN '' ELSE left(evidence, 80) || CASE WHEN m % 6 = 0 THEN ' 77 bar' ELSE '' END END AS raw_output FROM g1),
o1 AS (SELECT *, {t.sql_strip(_CUT)} AS output, regexp_replace(evidence, '{t.SPACE}', '', 'g') AS tight, lower(regexp_replace(question, '{t.SPACE}', '', 'g')) AS qk FROM o0),
o2 AS (SELECT *, {g.UNGROUNDED} AS nums, lower(regexp_replace(output, '{t.SPACE}', '', 'g')) AS ak, list_filter([{_WORDS(g.PROMISES)}], lambda w: contains(output, w) AND NOT contains(evidence, w)) AS promised FROM o1),
o3 AS (SELECT *, list_filter([{_FOREIGN}], lambda x: x IS NOT NULL AND x <> model_id) AS others FROM o2),
o4 AS (SELECT *, CASE WHEN len(others) > 0 THEN 'vehicle_conflict' WHEN len(nums) > 0 THEN 'ungrounded_number' WHEN len(list_filter([{_WORDS(g.INSURANCE)}], lambda w: contains(output, w) AND NOT contains(evidence, w))) > 0 THEN 'insurance_warranty_mix'
  WHEN {_HAS("output", g.DANGERS)} AND NOT {_HAS("output", g.GUARDS)} THEN 'unsafe_danger_advice' WHEN len(promised) > 0 THEN 'over_promise'
  WHEN output = '' THEN 'field_incomplete' WHEN length(output) > CASE WHEN task_type = 'steps' THEN 90 ELSE 800 END THEN 'length_out_of_bounds' END AS bad FROM o3),
c AS MATERIALIZED (SELECT *, NOT broken_answer AND bad IS NULL AS quality_ok, verdict IN {_GOOD} AS good FROM o4),
r AS (SELECT 0::BIGINT AS at, 0 AS had, 0 AS parts, NULL::VARCHAR AS outcome, false AS accepted
  UNION ALL SELECT c.plan_ord, had + (CASE WHEN good AND quality_ok AND NOT (verdict = 'partial_ok' AND parts >= 8) THEN 1 ELSE 0 END), parts + (CASE WHEN verdict = 'partial_ok' AND quality_ok AND parts < 8 THEN 1 ELSE 0 END),
   CASE WHEN verdict = 'partial_ok' AND parts >= 8 THEN 'partial_quota_full' WHEN good AND NOT quality_ok THEN 'quality' ELSE verdict END, good AND quality_ok AND NOT (verdict = 'partial_ok' AND parts >= 8)
  FROM r JOIN c ON c.plan_ord = r.at + 1 WHERE had < 40),
pooled AS (SELECT *, {_POOL} AS pool FROM c)
SELECT qid, model_id, task_type, chunk_id AS seed_chunk_id, accepted, CASE WHEN accepted THEN '' WHEN broken OR question = '' OR dup OR (outcome = 'quality' AND broken_answer) THEN 'generation' WHEN outcome = 'quality' THEN 'quality' ELSE 'answerability' END AS reject_stage,
CASE WHEN accepted THEN '' WHEN outcome = 'quality' THEN CASE WHEN broken_answer THEN 'json_parse_failed' ELSE bad END ELSE outcome END AS reject_reason,
CASE WHEN accepted OR outcome <> 'quality' OR broken_answer THEN '' WHEN bad = 'vehicle_conflict' THEN 'foreign=[''' || array_to_string(others, ''', ''') || ''']' WHEN bad = 'ungrounded_number' THEN 'nums=[''' || array_to_string(nums, ''', ''') || ''']'
  WHEN bad = 'over_promise' THEN 'words=[''' || array_to_string(promised, ''', ''') || ''']' WHEN bad = 'length_out_of_bounds' THEN 'len=' || length(output) ELSE '' END AS quality_detail,
md5(question) AS question, CASE WHEN accepted THEN outcome ELSE '' END AS tier, CASE WHEN accepted THEN pool[1 + ('0x' || md5(qid)[1:8])::BIGINT % len(pool)] ELSE '' END AS instruction, md5(CASE WHEN accepted THEN output ELSE '' END) AS output,
CASE WHEN accepted THEN ids ELSE '' END AS evidence_ids, (CASE WHEN accepted THEN seed_rank ELSE 0 END)::INT AS seed_rank FROM r JOIN pooled ON plan_ord = r.at"""


@t.query("generation_job", _SQL)
def generation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From chunks to accepted and rejected samples, in one wave after another."""
    return _shown(_generate(spark, sf_dir, shared_path(spark, "generation"), 60))


@t.query("generation_resumed", _SQL)
def generation_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a run that ends in its second wave, after its questions were asked, and one that goes on."""
    path = shared_path(spark, "generation")
    try:
        _generate(spark, sf_dir, path, 60, dies_at=2)
    except RuntimeError as x:
        if str(x) != "the run ends here":
            raise
    return _shown(_generate(spark, sf_dir, path, 60))
