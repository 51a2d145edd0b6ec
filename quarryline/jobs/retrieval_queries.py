"""Retrieval, its evaluation, routing and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.jobs import tables as t
from quarryline.operators import blockmax, bm25, chunking, completion, evaluation, fusion, retrieval, routing, sessions, toc, vectors, verify
from quarryline.operators.export import ordered
from quarryline.sources.scratch import shared_path, written


@t.query(
    "bm25_stats",
    f"""WITH {t.CHUNKS}, dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({t.TOKENS.format("text")})) AS term FROM chunks) GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM chunks) - df + 0.5) - ln(df + 0.5) AS r FROM dfs)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raws) ELSE r END, 6) AS idf FROM raws""",
)
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.chunks(spark, sf_dir)
    return bm25.term_statistics(rows).select("term", "df", F.round("idf", 6).alias("idf"))


@t.query("bm25_topk", f"WITH {t.CHUNKS}, {t.QUESTIONS}, {t.BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM btop")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(t.questions(spark, sf_dir), t.chunks(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@t.query("bm25_index_topk", t.SQL["bm25_topk"])
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that was written and read back."""
    rows, path = t.chunks(spark, sf_dir), shared_path(spark, "bm25")
    bm25.write_index(rows, path)
    found = bm25.search(t.questions(spark, sf_dir), rows, index=bm25.read_index(spark, path))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@t.query("bm25_index_delta", t.SQL["bm25_topk"])
def bm25_index_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that grew: a third of the chunks came later, a fifth had other texts at first."""
    rows, path = t.chunks(spark, sf_dir), shared_path(spark, "bm25")
    changed, later = F.col("chunk_ord") % 5 == 0, F.col("chunk_ord") % 3 == 0
    bm25.write_index(rows.where(~later).withColumn("text", F.when(changed, F.concat(F.lit("old words "), F.col("section_path"))).otherwise(F.col("text"))), path)
    bm25.update_index(spark, path, added=rows.where(later))
    bm25.update_index(spark, path, added=rows.where(~later & changed), removed=rows.where(~later & changed).select("chunk_id"))
    found = bm25.search(t.questions(spark, sf_dir), rows, index=bm25.read_index(spark, path, rows))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@t.query(
    "bm25_topk_filtered",
    f"""WITH {t.CHUNKS}, {t.QUESTIONS}, {t.BM25}, f AS (SELECT query_id, chunk_id, score, 0 AS padded, chunk_ord FROM bm JOIN chunks USING (chunk_id) WHERE doc_type = 'es'),
z AS (SELECT query_id, chunk_id, 0.0 AS score, 1 AS padded, chunk_ord FROM questions CROSS JOIN (SELECT chunk_id, chunk_ord FROM chunks WHERE doc_type = 'es' ORDER BY chunk_ord LIMIT 40) c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = questions.query_id AND f.chunk_id = c.chunk_id))
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_ord) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM z)) WHERE rank <= 20""",
)
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(t.questions(spark, sf_dir), t.chunks(spark, sf_dir), doc_types=["es"], pad_zero=True)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _near(spark: SparkSession, sf_dir: str, **options) -> DataFrame:  # noqa: ANN003
    return vectors.search(t.query_vectors(spark, sf_dir), t.corpus_vectors(spark, sf_dir), **options)


@t.query(
    "vector_topk",
    f"""WITH {t.CHUNKS}, {t.VECTORS} SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT v.query_id, v.chunk_id, v.score, row_number() OVER (PARTITION BY v.query_id ORDER BY v.score DESC, v.chunk_id) AS rank
  FROM vtop v JOIN cv USING (chunk_id) WHERE doc_type = 'en') WHERE rank <= 20""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, doc_types=["en"])


@t.query("vector_topk_prefilter", f"WITH {t.CHUNKS}, {t.VECTORS} SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims WHERE doc_type = 'fr') WHERE rank <= 20")
def vector_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, doc_types=["fr"], prefilter=True)


_FUSED = f"""{t.CHUNKS}, {t.QUESTIONS}, {t.BM25}, {t.VECTORS},
parts AS (SELECT query_id, chunk_id, 0.6 / (60 + rank) AS p, rank AS f FROM vtop WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 0.4 / (60 + rank), 1000 + rank FROM btop),
fz AS (SELECT query_id, chunk_id, sum(p) AS score, min(f) AS f FROM parts GROUP BY 1, 2),
fused AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, f) AS rank FROM fz) WHERE rank <= 10)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion([_near(spark, sf_dir), bm25.search(t.questions(spark, sf_dir), t.chunks(spark, sf_dir))], [0.6, 0.4], 10)


@t.query("hybrid_rrf", f"WITH {_FUSED} SELECT query_id, chunk_id, round(score, 9) AS score, rank::INT AS rank FROM fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 9))


@t.query(
    "hybrid_boosted",
    f"""WITH {_FUSED}, w AS (SELECT query_id, list_filter({t.TOKENS.format("question")}, lambda x: length(x) >= 2) AS ws FROM questions),
b AS (SELECT query_id, chunk_id, rank AS was, score * CASE WHEN len(list_filter(ws, lambda x: contains(lower(section_path), x))) > 0 THEN 1.5 ELSE 1 END AS score FROM fused JOIN chunks USING (chunk_id) JOIN w USING (query_id))
SELECT query_id, chunk_id, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, was))::INT AS rank FROM b""",
)
def hybrid_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir, tokens(F.col("question")))


def _boosted(spark: SparkSession, sf_dir: str, words: Column) -> DataFrame:
    asked = t.questions(spark, sf_dir).select("query_id", words.alias("words"))
    # lists that are written are known to be short: they go to the chunks, which stay where they lie
    rows = written(_fused(spark, sf_dir), "fused").join(t.chunks(spark, sf_dir).select("chunk_id", "section_path"), "chunk_id").join(asked, "query_id")
    return fusion.section_boost(rows, F.col("section_path"), F.col("words"), 1.5).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@t.query(
    "hybrid_per_model",
    f"""WITH {t.CHUNKS}, {t.QUESTIONS}, {t.BM25} SELECT query_id, doc_type, chunk_id, round(score, 6) AS score, rank::INT AS rank
FROM (SELECT bm.*, doc_type, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY round(score, 9) DESC, chunk_ord) AS rank FROM bm JOIN chunks USING (chunk_id)) WHERE rank <= 2""",
)
def hybrid_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language is covered by two chunks, as every model of a question would be."""
    rows, asked = t.chunks(spark, sf_dir), t.questions(spark, sf_dir)
    kinds = rows.select(F.col("doc_type").alias("target")).distinct()
    aims = asked.select("query_id").join(F.broadcast(kinds)).withColumn("target_no", F.dense_rank().over(Window.partitionBy("query_id").orderBy("target")))  # some languages
    found = blockmax.best_chunks(asked, rows, 2, aims, group="doc_type").join(aims, ["query_id", "target_no"])
    return found.select("query_id", F.col("target").alias("doc_type"), "chunk_id", F.round("score", 6).alias("score"), "rank")


@t.query(
    "merged_evidence",
    f"""WITH {t.CHUNKS}, {t.QUESTIONS}, {t.BM25}, {t.VECTORS},
l AS (SELECT query_id, chunk_id, score, 0 AS path_no, rank FROM btop WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, score, 1, rank FROM vtop WHERE rank <= 5),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY path_no, rank) AS nth FROM l) WHERE nth = 1),
n AS (SELECT query_id, chunk_id, score, path_no, row_number() OVER (PARTITION BY query_id ORDER BY path_no, rank) AS rank, sum((path_no = 0)::INT) OVER (PARTITION BY query_id) AS filled FROM o),
c AS (SELECT n.*, s.score AS sim FROM n LEFT JOIN vtop s USING (query_id, chunk_id) WHERE path_no = 0 OR n.rank <= greatest(8, filled + 1))
SELECT query_id, chunk_id, round(coalesce(sim, score), 6) AS score, path_no, rank::INT AS rank, NOT coalesce(sim < 0.3, false) AS kept FROM c""",
)
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = written(_near(spark, sf_dir, k=60, over_fetch=1), "near")  # met twice
    words = bm25.search(t.questions(spark, sf_dir), t.chunks(spark, sf_dir), 5)
    merged = fusion.merge_paths([words, near.where("rank <= 5")], 8)
    merged = written(merged.join(near.select("query_id", "chunk_id", F.col("score").alias("similarity")), ["query_id", "chunk_id"], "left"), "merged")  # or the search runs for each side of the floor
    kept, dropped = fusion.similarity_floor(merged, 0.3)
    both = kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("score", F.col("similarity")).withColumn("kept", F.lit(False)))
    return both.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "path_no", "rank", "kept")


@t.query(
    "text_lookup",
    f"""WITH {t.CHUNKS}, m AS (SELECT item_id AS case_id, chunk_id, section_path, chunks.text AS txt, b.text AS needle, strpos(lower(chunks.text), lower(b.text)) - 1 AS at0 FROM chunks JOIN benchmark b ON contains(lower(chunks.text), lower(b.text)))
SELECT case_id, chunk_id, section_path, CASE WHEN at0 > 40 THEN '…' ELSE '' END || substring(txt, greatest(0, at0 - 40) + 1, least(length(txt), at0 + length(needle) + 80) - greatest(0, at0 - 40)) || CASE WHEN at0 + length(needle) + 80 < length(txt) THEN '…' ELSE '' END AS snippet FROM m""",
)
def text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.text_lookup(t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("needle")), t.chunks(spark, sf_dir))


_EVAL = f"""chunks AS (SELECT doc_id || ':' || (pos // 800) AS chunk_id, doc_id * 100000 + pos // 800 AS chunk_ord, {t.sql_strip("substring(text, greatest(0, pos - 150) + 1, least(length(text), pos + 950) - greatest(0, pos - 150))")} AS text
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS pos FROM documents)), {t.QUESTIONS}, {t.BM25},
truth AS (SELECT item_id AS case_id, chunk_id FROM chunks JOIN benchmark b ON contains(lower(chunks.text), lower(b.text))),
mt AS (SELECT case_id, count(*) AS n_expected, count(btop.chunk_id) AS n_matched FROM truth LEFT JOIN btop ON btop.query_id = case_id AND btop.chunk_id = truth.chunk_id GROUP BY 1),
met AS (SELECT query_id AS case_id, coalesce(n_expected, 0) AS n_expected, coalesce(n_matched, 0) AS n_matched, CASE WHEN n_expected > 0 THEN (n_matched > 0)::INT END AS hit, CASE WHEN n_expected > 0 THEN n_matched / n_expected END AS recall FROM questions LEFT JOIN mt ON mt.case_id = query_id)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = chunking.fixed_windows(docs).select(F.concat_ws(":", "doc_id", "win_no").alias("chunk_id"), (F.col("doc_id") * 100_000 + F.col("win_no")).alias("chunk_ord"), "text", F.lit("").alias("vehicle_model"), F.lit("").alias("doc_type"), F.lit("").alias("section_path"))
    rows = written(rows, "windows")
    asked = t.questions(spark, sf_dir)
    cases = asked.select(F.col("query_id").alias("case_id"), F.array().cast("array<string>").alias("expected_chunk_ids"))
    found = evaluation.text_lookup(asked.select(F.col("query_id").alias("case_id"), F.col("question").alias("needle")), rows)
    expected = written(evaluation.expected_ids(cases, found), "expected")  # counted and met
    return evaluation.case_metrics(cases, bm25.search(asked, rows).withColumnRenamed("query_id", "case_id"), expected)


@t.query("retrieval_metrics", f"WITH {_EVAL} SELECT case_id, n_expected, n_matched, hit, round(recall, 6) AS recall FROM met")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).withColumn("recall", F.round("recall", 6))


@t.query("retrieval_summary", f"WITH {_EVAL} SELECT count(*) AS cases, count(hit) AS measured, round(avg(hit), 6) AS hit_rate, round(avg(recall), 6) AS mean_recall FROM met")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_measured(spark, sf_dir)).select("cases", "measured", F.round("hit_rate", 6).alias("hit_rate"), F.round("mean_recall", 6).alias("mean_recall"))


@t.query(
    "evidence_context",
    f"""WITH {t.CHUNKS}, {t.QUESTIONS}, {t.BM25} SELECT query_id, md5(string_agg(text, chr(10) ORDER BY rank)) AS evidence_md5, string_agg(chunk_id, ',' ORDER BY rank) AS evidence_ids FROM btop JOIN chunks USING (chunk_id) WHERE rank <= 5 GROUP BY 1""",
)
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.chunks(spark, sf_dir)
    found = bm25.search(t.questions(spark, sf_dir), rows, 5).join(rows.select("chunk_id", "text"), "chunk_id")
    return found.groupBy("query_id").agg(F.md5(F.array_join(ordered("rank", "text"), "\n")).alias("evidence_md5"), F.array_join(ordered("rank", "chunk_id"), ",").alias("evidence_ids"))


ALIASES = [("m1", "the the"), ("m1", "that"), ("m2", "tion"), ("m2", "ation the"), ("m3", "le la"), ("m4", "der die"), ("m4", "die"), ("m5", "que")]


def _route_sql() -> str:
    """The same by one step for each alias, longest first."""
    steps, last = ["r0 AS (SELECT doc_id, lower(regexp_replace(text || ' ', '" + t.SPACE + "', '', 'g')) AS hay, [] ::VARCHAR[] AS found FROM documents)"], "r0"
    order = sorted(((m, a.replace(" ", "")) for m, a in ALIASES), key=lambda x: -len(x[1]))
    for i, (m, a) in enumerate(order, 1):
        hit = f"strpos(hay, '{a}') > 0 AND NOT list_contains(found, '{m}')"
        steps.append(f"r{i} AS (SELECT doc_id, CASE WHEN {hit} THEN substring(hay, 1, strpos(hay, '{a}') - 1) || repeat(chr(1), {len(a)}) || substring(hay, strpos(hay, '{a}') + {len(a)}) ELSE hay END AS hay, CASE WHEN {hit} THEN list_append(found, '{m}') ELSE found END AS found FROM {last})")
        last = f"r{i}"
    return f"WITH {', '.join(steps)} SELECT doc_id, array_to_string(found, ',') AS models FROM {last}"


@t.query("route_models", _route_sql())
def route_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.route(F.col("text"), F.lit(None).cast("string"), ALIASES)
    return t.table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("models"))


@t.query(
    "file_models",
    "SELECT source AS file, count(*) AS docs, CASE WHEN source IN ('src3', 'src7') THEN NULL ELSE 'M-' || source END AS model_id FROM documents GROUP BY 1",
)
def file_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("docs"))
    models = files.where("file NOT IN ('src3', 'src7')").select("file", F.concat(F.lit("M-"), "file").alias("model_id"))
    known, unknown = routing.file_models(files, models)
    return known.unionByName(unknown.withColumn("model_id", F.lit(None).cast("string")))


_TURNS = """said AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS after, lead(text) OVER w AS answer FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id AS session_id, turn, text AS question, answer FROM said WHERE role = 'user' AND after = 'assistant'),
uses AS (SELECT session_id, turn, unnest(range(4))::INT AS pos FROM turns), used AS (SELECT session_id, turn, pos, ((session_id * 7919 + turn * 104729 + pos * 1299709) % (SELECT max(doc_id) + 1 FROM documents WHERE text IS NOT NULL))::VARCHAR AS chunk_id FROM uses)"""
_CACHE = (
    _TURNS
    + """, lst AS (SELECT t.session_id, t.turn, chunk_id, max(u.turn * 100 + pos) AS at0 FROM turns t JOIN used u ON u.session_id = t.session_id AND u.turn < t.turn GROUP BY ALL),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY at0 DESC, chunk_id) AS age FROM lst) WHERE age <= 6),
cache AS (SELECT session_id, turn, chunk_id, (row_number() OVER (PARTITION BY session_id, turn ORDER BY at0, chunk_id DESC))::INT AS cache_pos FROM few)"""
)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.turns_of(t.table(spark, sf_dir, "conversations"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of chunks of the whole table: ids are multiplied by primes, so that few sessions too use chunks from all of it."""
    n = t.chunks(spark, sf_dir).agg((F.max("chunk_ord") + 1).alias("n_chunks"))
    turns = _turns(spark, sf_dir)
    used = (F.col("session_id") * 7919 + F.col("turn") * 104_729 + F.col("pos") * 1_299_709) % F.col("n_chunks")
    uses = turns.select("session_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).join(F.broadcast(n)).withColumn("chunk_id", used.cast("string")).drop("n_chunks")  # n has one row
    return sessions.cache_before(turns, uses, 6)


@t.query(
    "session_history",
    f"""WITH {_TURNS} SELECT session_id, turn, md5(lag(question) OVER w) AS last_question, md5(lag(answer) OVER w) AS last_answer,
md5(coalesce(string_agg(question, '|') OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '')) AS recent, md5(coalesce(string_agg(question, '|') OVER (w ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING), '')) AS earlier FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn)""",
)
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.history(_turns(spark, sf_dir), 3)
    return rows.select("session_id", "turn", F.md5("last_question").alias("last_question"), F.md5("last_answer").alias("last_answer"), *[F.md5(F.array_join(c, "|")).alias(c) for c in ("recent", "earlier")])


@t.query(
    "sticky_models",
    f"""WITH {_TURNS}, f AS (SELECT session_id, turn, CASE WHEN contains(lower(question), 'the the') THEN 'a' WHEN contains(lower(question), 'que') THEN 'b' END AS m FROM turns)
SELECT session_id, turn, coalesce(m, last_value(m IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS active,
coalesce(m, last_value(m IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) IS NULL AS needs_clarification FROM f""",
)
def sticky_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lower("question")
    found = F.when(F.contains(q, F.lit("the the")), F.array(F.lit("a"))).when(F.contains(q, F.lit("que")), F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return routing.sticky(_turns(spark, sf_dir).withColumn("found", found)).select("session_id", "turn", F.array_join("active", ",").alias("active"), "needs_clarification")


@t.query("lru_cache", f"WITH {_CACHE} SELECT * FROM cache")
def lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir)


@t.query(
    "section_hints",
    f"""WITH {_CACHE}, {t.CHUNKS}, s AS (SELECT session_id, turn, section_path, min(cache_pos) AS pos FROM cache JOIN chunks USING (chunk_id) WHERE section_path <> '' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY pos) AS nth FROM s) SELECT session_id, turn, string_agg(section_path, '|' ORDER BY pos) AS hints FROM n WHERE nth <= 5 GROUP BY 1, 2""",
)
def section_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.section_hints(_cache(spark, sf_dir), t.chunks(spark, sf_dir)).withColumn("hints", F.array_join("hints", "|"))


@t.query(
    "cache_reuse",
    f"""WITH {_CACHE}, q AS (SELECT session_id, turn, embedding::DOUBLE[] AS e FROM turns JOIN embeddings ON vec_id = (session_id * 7919 + turn * 104729) % (SELECT max(vec_id) + 1 FROM embeddings)),
s AS (SELECT session_id, turn, chunk_id, cache_pos, round(list_dot_product(v.embedding::DOUBLE[], q.e), 9) AS score FROM cache JOIN embeddings v ON v.vec_id::VARCHAR = chunk_id JOIN q USING (session_id, turn)),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY score DESC, cache_pos) AS rank FROM s WHERE score >= 0.1) SELECT session_id, turn, chunk_id, score, rank::INT AS rank FROM r WHERE rank <= 3""",
)
def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = t.table(spark, sf_dir, "embeddings")
    n = vecs.agg((F.max("vec_id") + 1).alias("n_vectors"))
    asked = _turns(spark, sf_dir).join(F.broadcast(n)).withColumn("vec_id", (F.col("session_id") * 7919 + F.col("turn") * 104_729) % F.col("n_vectors"))  # n has one row
    asked = asked.join(vecs, "vec_id").select("session_id", "turn", "embedding")
    return sessions.cache_reuse(_cache(spark, sf_dir), asked, vecs.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding"), 0.1)


def _verifier():  # noqa: ANN202
    """A completion function for tests: yes to chunks of numbers that three doesn't divide, an error where eleven does."""

    def ask(prompt: str) -> str:
        n = int(prompt.split("\n")[0])
        if n % 11 == 0:
            raise ValueError("no answer")
        return "是" if n % 3 else "否\nnot about it"

    return ask


@t.query(
    "verified_evidence",
    f"""WITH {t.CHUNKS}, {t.QUESTIONS}, {t.BM25}, r AS (SELECT query_id, chunk_id, rank, round(score, 6) AS score, rank = 2 AS from_toc, chunk_id::BIGINT % 11 = 0 OR chunk_id::BIGINT % 3 <> 0 AS kept FROM btop WHERE rank <= 5),
n AS (SELECT *, sum(kept::INT) OVER (PARTITION BY query_id) AS nk, row_number() OVER (PARTITION BY query_id, kept ORDER BY score DESC, rank) AS nth FROM r WHERE NOT from_toc),
b AS (SELECT query_id, chunk_id, rank, 1 AS g FROM n WHERE kept OR nk = 0 OR nth <= 2 - nk UNION ALL SELECT query_id, chunk_id, rank, 0 FROM r WHERE from_toc)
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY g, rank))::INT AS position FROM b""",
)
def verified_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bm25.search(t.questions(spark, sf_dir), t.chunks(spark, sf_dir), 5)
    asked = rows.select("query_id", "chunk_id", F.col("rank").alias("pos"), F.round("score", 6).alias("score"), (F.col("rank") == 2).alias("from_toc"), completion.render("{id}\n{rank}", id=F.col("chunk_id"), rank=F.col("rank")).alias("prompt"))
    return verify.verify_chunks(asked, _verifier, 2)


@t.query(
    "stage_counts",
    f"""WITH {t.CHUNKS}, {t.QUESTIONS}, {t.BM25}, {t.VECTORS} SELECT query_id, 'bm25' AS stage, count(*) AS chunks FROM btop GROUP BY 1 UNION ALL SELECT query_id, 'vector', count(*) FROM vtop WHERE rank <= 20 GROUP BY 1
UNION ALL SELECT query_id, 'near', count(*) FROM vtop WHERE rank <= 20 AND score >= 0.3 GROUP BY 1""",
)
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of each query come to each stage."""
    near = written(_near(spark, sf_dir), "near")  # two stages
    parts = {"bm25": bm25.search(t.questions(spark, sf_dir), t.chunks(spark, sf_dir)), "vector": near, "near": near.where("score >= 0.3")}
    trace = [p.select("query_id", F.lit(stage).alias("stage")) for stage, p in parts.items()]
    return fusion.stage_counts(trace[0].unionByName(trace[1]).unionByName(trace[2]))


@t.query("model_names", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN upper(source) ELSE source END AS display FROM documents")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for display: some models of the registry have one, the others show their id."""
    rows = t.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model_id"))
    models = rows.select("model_id").distinct().select("model_id", F.when(F.col("model_id").isin("src1", "src2"), F.upper("model_id")).alias("name"))
    return routing.display_names(rows, models).select("doc_id", "display")


#: Names that questions may hold, none of which can share a letter with another in a text, and the models that they stand for.
NAMES = [("src1", "tion"), ("src2", "der"), ("src3", "ing"), ("src4", "qu")]
#: The fused list of one path for each target, in SQL: name, vectors' list, words' scores, both weights, size.
LISTS = """{0}v AS (SELECT query_id, no, chunk_id, score, rank FROM (SELECT v.query_id, no, v.chunk_id, v.score, row_number() OVER (PARTITION BY v.query_id, no ORDER BY v.score DESC, v.chunk_id) AS rank
  FROM {1} v JOIN chunks c USING (chunk_id) JOIN aims a ON a.query_id = v.query_id AND (target IS NULL OR target = c.vehicle_model) WHERE v.rank <= 60) WHERE rank <= 20),
{0}b AS (SELECT query_id, no, chunk_id, rank FROM (SELECT b.query_id, no, b.chunk_id, row_number() OVER (PARTITION BY b.query_id, no ORDER BY round(b.score, 9) DESC, chunk_ord) AS rank
  FROM {2} b JOIN chunks c USING (chunk_id) JOIN aims a ON a.query_id = b.query_id AND (target IS NULL OR target = c.vehicle_model)) WHERE rank <= 20),
{0}s AS (SELECT query_id, no, chunk_id, sum(p) AS score, min(f) AS f FROM (SELECT query_id, no, chunk_id, {3} / (60 + rank) AS p, rank AS f FROM {0}v UNION ALL SELECT query_id, no, chunk_id, {4} / (60 + rank), 1000 + rank FROM {0}b) GROUP BY ALL),
{0}f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, no ORDER BY round(score, 9) DESC, f) AS rank FROM {0}s) WHERE rank <= {5})"""
_JOB = rf"""{t.TOC_PATHS}, {t.CHUNKS}, {t.QUESTIONS}, {t.BM25}, {t.VECTORS},
named AS (SELECT query_id, list_filter([{", ".join(f"CASE WHEN contains(lower(regexp_replace(question, '{t.SPACE}', '', 'g')), '{a}') THEN '{m}' END" for m, a in NAMES)}], lambda x: x IS NOT NULL) AS ms FROM questions),
aims AS (SELECT query_id, unnest(ms) AS target, unnest(range(len(ms))) AS no FROM named UNION ALL SELECT query_id, NULL, 0 FROM named WHERE len(ms) = 0),
kq AS (SELECT query_id, array_to_string(list_filter({t.TOKENS.format("question")}, lambda x: length(x) >= 6), ',') AS keyword FROM questions),
kasked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({t.TOKENS.format("keyword")}) AS term FROM kq) GROUP BY ALL),
kbm AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dls)))) AS score FROM post JOIN kasked USING (term) JOIN idfs USING (term) JOIN dls USING (chunk_id) GROUP BY ALL),
kqv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = (item_id * 7 + 1) % (SELECT max(vec_id) + 1 FROM embeddings)),
kvtop AS (SELECT * FROM (SELECT query_id, chunk_id, round(list_dot_product(kqv.e, cv.e), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(kqv.e, cv.e), 9) DESC, chunk_id) AS rank FROM kqv CROSS JOIN cv) WHERE rank <= 60),
{LISTS.format("r", "vtop", "bm", 0.6, 0.4, 5)}, {LISTS.format("k", "kvtop", "kbm", 0.4, 0.6, 2)},
kboost AS (SELECT kf.query_id, no, chunk_id, rank, score * CASE WHEN len(list_filter(string_split(keyword, ','), lambda w: length(w) >= 2 AND contains(lower(section_path), w))) > 0 THEN 1.1 ELSE 1 END AS score FROM kf JOIN chunks USING (chunk_id) JOIN kq USING (query_id)),
rp AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY no, rank) AS rank FROM rf),
kr AS (SELECT query_id, no, chunk_id, score, row_number() OVER (PARTITION BY query_id, no ORDER BY round(score, 9) DESC, rank) AS rank FROM kboost),
kp AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY no, rank) AS rank FROM kr),
ml AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY path_no, rank) AS nth FROM (SELECT *, 0 AS path_no FROM rp UNION ALL SELECT *, 1 FROM kp)),
mr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY path_no, rank) AS rank FROM ml WHERE nth = 1),
merged AS (SELECT mr.*, coalesce(kv.score, rv.score) AS sim FROM mr JOIN named USING (query_id) LEFT JOIN (SELECT query_id, chunk_id, any_value(score) AS score FROM kv GROUP BY 1, 2) kv USING (query_id, chunk_id) LEFT JOIN (SELECT query_id, chunk_id, any_value(score) AS score FROM rv GROUP BY 1, 2) rv USING (query_id, chunk_id) WHERE mr.rank <= 7 * greatest(1, len(ms))),
kept AS (SELECT query_id, chunk_id, rank, coalesce(sim, score) AS score, chunk_id::BIGINT % 11 = 0 OR chunk_id::BIGINT % 3 <> 0 AS yes FROM merged WHERE NOT coalesce(sim < 0.2, false)),
vn AS (SELECT *, sum(yes::INT) OVER (PARTITION BY query_id) AS nk, row_number() OVER (PARTITION BY query_id, yes ORDER BY round(score, 9) DESC, rank) AS nth FROM kept),
verified AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM vn WHERE yes OR nk = 0 OR nth <= 2 - nk),
parts2 AS (SELECT p.*, list_filter(string_split(lower(path), '>'), lambda x: x <> '') AS pp, lower(path || '>' || title) AS hay FROM (SELECT *, lead(level) OVER (PARTITION BY source_file ORDER BY ord) AS after FROM paths) p WHERE after IS NULL OR after <= level),
every AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS mno FROM (SELECT DISTINCT vehicle_model AS m FROM parts2 WHERE vehicle_model IS NOT NULL)),
caims AS (SELECT query_id, target, no FROM aims WHERE target IS NOT NULL UNION ALL SELECT query_id, m, mno FROM aims CROSS JOIN every WHERE target IS NULL),
asked2 AS (SELECT query_id, question, no, target, list_distinct(list_filter({t.TOKENS.format("question")}, lambda x: length(x) >= 2)) AS words FROM questions JOIN caims USING (query_id)),
raw2 AS (SELECT a.query_id, a.no, a.question, p.*, coalesce(list_sum(list_transform(words, lambda w: (CASE WHEN contains(hay, w) THEN 1 ELSE 0 END) + 2 * len(list_filter(pp, lambda x: contains(x, w) OR contains(w, x))))), 0)::DOUBLE AS m
  FROM asked2 a JOIN parts2 p ON a.target = p.vehicle_model WHERE len(words) > 0),
best2 AS (SELECT *, round(m + length(path) * 0.01 - CASE WHEN contains(path, 'The') AND NOT contains(question, 'The') THEN 3 ELSE 0 END, 6) AS es FROM raw2),
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY no, p0) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, no ORDER BY es DESC, ord, source_file) AS p0 FROM best2 WHERE es > 0) WHERE p0 <= 3),
sel2 AS (SELECT sel.*, (SELECT arg_min(page, ord) FROM toc o WHERE o.source_file = sel.source_file AND o.ord > sel.ord AND o.level <= sel.level) AS nxt FROM sel),
ranged2 AS (SELECT *, CASE WHEN nxt IS NULL THEN (SELECT max(page) FROM toc) ELSE greatest(page, nxt - 1) END AS end_page FROM sel2),
tc AS (SELECT r.query_id, r.position, c.chunk_id, row_number() OVER (PARTITION BY r.query_id, r.position ORDER BY CASE WHEN {{fit_title}} OR {{fit_path}} THEN 0 ELSE 1 END, c.page, chunk_ord) AS nth FROM ranged2 r JOIN chunks c USING (vehicle_model) WHERE c.page BETWEEN r.page AND r.end_page),
listed AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position FROM (SELECT query_id, chunk_id, min(position * 1000 + nth) AS place FROM tc WHERE nth <= 2 GROUP BY 1, 2)),
fl AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part) AS nth FROM (SELECT query_id, chunk_id, 1.0 AS score, position, 0 AS part FROM listed UNION ALL SELECT query_id, chunk_id, score, position, 1 FROM verified)),
final AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY part, position) AS position FROM fl WHERE nth = 1),
trace AS (SELECT query_id, 'rewritten' AS stage, rank AS position, chunk_id, score FROM rp UNION ALL SELECT query_id, 'keyword', rank, chunk_id, score FROM kp UNION ALL SELECT query_id, 'merged', rank, chunk_id, score FROM merged
  UNION ALL SELECT query_id, 'below_floor', rank, chunk_id, sim FROM merged WHERE sim < 0.2 UNION ALL SELECT query_id, 'contents', position, chunk_id, 1.0 FROM listed UNION ALL SELECT query_id, 'verified', position, chunk_id, score FROM verified
  UNION ALL SELECT query_id, 'final', position, chunk_id, score FROM final)"""
_FIT = "(trim(r.{0}) <> '' AND section_path <> '' AND (contains(section_path, trim(r.{0})) OR len(list_filter(string_split(section_path, '>'), lambda x: contains(x, trim(r.{0})) OR contains(trim(r.{0}), x))) > 0))"
_JOB = _JOB.replace("{fit_title}", _FIT.format("title")).replace("{fit_path}", _FIT.format("path"))


def _job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the benchmark, its long words as the keyword line, about the models that it names."""
    vecs = t.table(spark, sf_dir, "embeddings")
    last = vecs.agg((F.max("vec_id") + 1).alias("n"))
    questions = t.questions(spark, sf_dir).select("query_id", "question").join(F.broadcast(last))  # one row
    questions = questions.withColumns({"rewritten": F.col("question"), "keyword": F.array_join(F.filter(tokens(F.col("question")), lambda x: F.length(x) >= 6), ","), "models": routing.route(F.col("question"), F.lit(None).cast("string"), NAMES), "other": (F.col("query_id") * 7 + 1) % F.col("n")})
    asked = questions.join(vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("rewritten_vector")), "query_id", "left").join(vecs.select(F.col("vec_id").alias("other"), F.col("embedding").alias("keyword_vector")), "other", "left").drop("other", "n")
    entries = toc.with_leaves(toc.toc_paths(t.toc(spark, sf_dir)))
    entries = toc.page_ends(entries.join(F.broadcast(entries.agg(F.max("page").alias("max_page")))), F.col("max_page"), 4).withColumn("ord", F.struct("ord", "source_file"))  # one row
    prompt = lambda question, text: F.concat(text, F.lit("\n"), question)
    return retrieval.retrieve(written(asked, "asked"), t.chunks(spark, sf_dir), t.corpus_vectors(spark, sf_dir), written(entries, "entries"), _verifier, prompt, settings=retrieval.Settings(general=("The",)))


@t.query("retrieval_job", f"WITH RECURSIVE {_JOB} SELECT query_id, stage, position::INT AS position, chunk_id, round(score, 6) AS score FROM trace")
def retrieval_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question from its words to its evidence, stage by stage."""
    return _job(spark, sf_dir).withColumn("score", F.round("score", 6))


@t.query(
    "retrieval_vectors",
    f"""WITH {t.CHUNKS}, {t.VECTORS}, {t.QUESTIONS},
named AS (SELECT query_id, list_filter([{", ".join(f"CASE WHEN contains(lower(regexp_replace(question, '{t.SPACE}', '', 'g')), '{a}') THEN '{m}' END" for m, a in NAMES)}], lambda x: x IS NOT NULL) AS ms FROM questions),
aims AS (SELECT query_id, unnest(ms) AS target, unnest(range(len(ms)))::INT AS no FROM named UNION ALL SELECT query_id, NULL, 0 FROM named WHERE len(ms) = 0)
SELECT query_id, target_no, chunk_id, score, rank::INT AS rank FROM (SELECT v.query_id, no AS target_no, v.chunk_id, v.score, row_number() OVER (PARTITION BY v.query_id, no ORDER BY v.score DESC, v.chunk_id) AS rank
  FROM vtop v JOIN chunks c USING (chunk_id) JOIN aims a ON a.query_id = v.query_id AND (target IS NULL OR target = c.vehicle_model) WHERE v.rank <= 15) WHERE rank <= 5""",
)
def retrieval_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten path without words: similarities, for each model that a question names."""
    vecs = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = t.questions(spark, sf_dir).withColumn("models", routing.route(F.col("question"), F.lit(None).cast("string"), NAMES)).join(vecs, "query_id", "left")
    found, _ = retrieval.hybrid(asked.select("query_id", "question", "embedding"), retrieval.targets(asked), t.chunks(spark, sf_dir), t.corpus_vectors(spark, sf_dir), 5, 0.4, retrieval.Settings(), use_words=False)
    return found.select("query_id", F.col("target_no").cast("int").alias("target_no"), "chunk_id", "score", "rank")


@t.query(
    "first_seen_chunks",
    f"""WITH {t.CHUNKS}, m AS (SELECT chunk_id, min((item_id, chunk_id)) AS f FROM chunks JOIN benchmark b ON contains(lower(chunks.text), lower(b.text)) GROUP BY 1) SELECT chunk_id, row_number() OVER (ORDER BY f) AS place FROM m""",
)
def first_seen_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that hold any of the benchmark's texts, in the order in which they are found."""
    found = evaluation.text_lookup(t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("needle")), t.chunks(spark, sf_dir))
    return evaluation.first_seen(found, ["case_id", "chunk_id"])


_PROMPTS = {"verify": "Question: {source}\n{text}\nRelevant?", "rewrite": "Said: {text}\nAsked: {lang} {doc_id}\nRewritten:"}


@t.query(
    "prompts",
    r"""SELECT doc_id, md5('Question: ' || coalesce(source, '') || chr(10) || s || chr(10) || 'Relevant?') AS verify, md5('Said: ' || s || chr(10) || 'Asked: ' || coalesce(lang, '') || ' ' || doc_id || chr(10) || 'Rewritten:') AS rewrite
FROM (SELECT *, CASE WHEN length(coalesce(text, '')) > 400 THEN left(text, 400) || '……' ELSE coalesce(text, '') END AS s FROM documents)""",
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prompts for each document, long texts shortened."""
    rows = completion.prompts(t.table(spark, sf_dir, "documents"), _PROMPTS, {"text": (400, "……")})
    return rows.select("doc_id", *[F.md5(c).alias(c) for c in _PROMPTS])


@t.query("rewritten_lines", f"SELECT doc_id, md5(CASE WHEN s = '' THEN coalesce(source, '') ELSE s END) AS rewritten FROM (SELECT doc_id, source, coalesce({t.sql_strip("string_split(" + t.sql_strip("text") + ", chr(10))[1]")}, '') AS s FROM documents)")
def rewritten_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text as the answer to a request for a rewritten question: its first line, or the question."""
    return t.table(spark, sf_dir, "documents").select("doc_id", F.md5(completion.clean_rewrite(F.col("text"), F.coalesce("source", F.lit("")))).alias("rewritten"))
