"""The library's tables as they derive from the driver's, in DataFrames and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Documents in fewer files than there are cores (a file here is one row group, which one task reads) are dealt to all cores
    by id, as work on texts costs far more than moving them; a table of many files is read as it lies."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, "doc_id") if name == "documents" and len(rows.inputFiles()) < cores else rows


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a chunk; its source is the model, its first words the section."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("doc_id").alias("chunk_ord"),
        "text",
        F.col("source").alias("vehicle_model"),
        F.col("lang").alias("doc_type"),
        F.replace(F.regexp_extract("text", r"^[^ \n]+(?: [^ \n]+){0,2}", 0), F.lit(" "), F.lit(">")).alias("section_path"),
        (1 + F.col("doc_id") % 40).cast("int").alias("page"),
    )


CHUNKS = r"""chunks AS (SELECT doc_id::VARCHAR AS chunk_id, doc_id AS chunk_ord, text, source AS vehicle_model, lang AS doc_type,
  replace(regexp_extract(text, '^[^ \n]+(?: [^ \n]+){0,2}'), ' ', '>') AS section_path, (1 + doc_id % 40)::INT AS page FROM documents WHERE text IS NOT NULL)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = """lines AS (SELECT doc_id, source, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as text blocks, with sizes and weights by their numbers; every third is cut to the length of a heading."""
    d, n = F.col("doc_id"), F.col("line_no")
    return lines(spark, sf_dir).where("line <> ''").select(
        d.cast("string").alias("source_file"),
        (1 + F.floor(n / 5)).cast("int").alias("page"),
        n.alias("block_no"),
        F.when((d + n) % 3 == 0, F.left("line", F.lit(30))).otherwise(F.col("line")).alias("text"),
        (10.0 + 2 * ((7 * d + 3 * n) % 5)).cast("double").alias("font_size"),
        (n % 4 == 0).alias("is_bold"),
    )


BLOCKS = (
    LINES
    + """, blocks AS (SELECT doc_id::VARCHAR AS source_file, (1 + line_no // 5)::INT AS page, line_no AS block_no,
  CASE WHEN (doc_id + line_no) % 3 = 0 THEN left(line, 30) ELSE line END AS text, (10 + 2 * ((7 * doc_id + 3 * line_no) % 5))::DOUBLE AS font_size, line_no % 4 = 0 AS is_bold
  FROM lines WHERE line <> '')"""
)


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entries of a table of contents for each document."""
    d, n = F.col("doc_id"), F.col("line_no")
    return lines(spark, sf_dir).where("line <> ''").select(
        d.cast("string").alias("source_file"),
        F.col("source").alias("vehicle_model"),
        n.alias("ord"),
        (1 + (5 * d + 3 * n) % 4).cast("int").alias("level"),
        F.col("line").alias("title"),
        (1 + F.floor(n / 2)).cast("int").alias("page"),
    )


TOC = (
    LINES
    + """, toc AS (SELECT doc_id::VARCHAR AS source_file, source AS vehicle_model, line_no AS ord, (1 + (5 * doc_id + 3 * line_no) % 4)::INT AS level, line AS title,
  (1 + line_no // 2)::INT AS page FROM lines WHERE line <> '')"""
)
#: The stack of titles by recursion, row by row.
TOC_PATHS = (
    TOC
    + """, nt AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ord) AS rn FROM toc),
st AS (SELECT source_file, rn, [title] AS s FROM nt WHERE rn = 1
  UNION ALL SELECT nt.source_file, nt.rn, list_append(st.s[1:nt.level - 1], nt.title) FROM st JOIN nt ON nt.source_file = st.source_file AND nt.rn = st.rn + 1),
paths AS (SELECT nt.*, array_to_string(st.s, '>') AS path FROM nt JOIN st USING (source_file, rn))"""
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions, each about one of twenty models."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("vehicle_model"))


QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question, 'src' || (item_id % 20) AS vehicle_model FROM benchmark)"


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents that have one."""
    facts = chunks(spark, sf_dir).select("chunk_id", "vehicle_model", "doc_type")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding").join(facts, "chunk_id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")


VECTORS = """cv AS (SELECT vec_id::VARCHAR AS chunk_id, embedding::DOUBLE[] AS e, vehicle_model, doc_type FROM embeddings JOIN chunks ON chunk_id = vec_id::VARCHAR),
qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
sims AS (SELECT query_id, chunk_id, vehicle_model, doc_type, round(list_dot_product(qv.e, cv.e), 9) AS score FROM qv CROSS JOIN cv),
vtop AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims) WHERE rank <= 60)"""

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
BM25 = f"""tok AS (SELECT chunk_id, unnest({TOKENS.format("text")}) AS term FROM chunks),
post AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM tok GROUP BY ALL),
dls AS (SELECT chunk_id, len({TOKENS.format("text")}) AS dl FROM chunks),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM chunks) - df + 0.5) - ln(df + 0.5) AS r FROM dfs),
idfs AS MATERIALIZED (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raws) ELSE r END AS idf FROM raws),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("question")}) AS term FROM questions) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dls)))) AS score
  FROM post JOIN asked USING (term) JOIN idfs USING (term) JOIN dls USING (chunk_id) GROUP BY ALL),
btop AS (SELECT query_id, chunk_id, score, rank FROM (SELECT bm.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_ord) AS rank FROM bm JOIN chunks USING (chunk_id)) WHERE rank <= 20)"""
