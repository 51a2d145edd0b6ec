"""Reading and writing corpora, tables of contents, datasets and run ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarryline.functions.text import strip

BLOCKS = "source_file string, page int, block_no int, text string, font_size double, is_bold boolean"
TOC = "source_file string, vehicle_model string, ord int, level int, title string, page int, path string"
META = "struct<chunk_id:string,vehicle_model:string,doc_type:string,source_file:string,page:int,section_path:string,image_refs:array<string>>"
CORPUS = f"chunk_ids array<string>, texts array<string>, metadatas array<{META}>"
META_FIELDS = (
    "qid string, model_id string, model_display string, doc_type string, section_path string, task_type string, seed_chunk_id string, seed_preview string, seed_score double, "
    "evidence_chunk_ids array<string>, evidence_previews array<string>, retrieval_scores array<double>, max_score double, seed_rank int, same_section_count long, "
    "evidence_sufficiency string, accept_tier string, backend string, gen_question_raw string"
)
SAMPLE = "instruction string, input string, output string"
REJECTED = "qid string, model_id string, section_path string, task_type string, seed_chunk_id string, seed_preview string, reject_stage string, reject_reason string, reject_detail string, question string"
ACCEPTED = "qid string, meta struct<model_id:string,task_type:string,accept_tier:string,gen_question_raw:string>, sample struct<instruction:string,input:string,output:string>"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Parsed page blocks without the blank ones."""
    return spark.read.schema(BLOCKS).parquet(path).where(strip(F.col("text")) != "")


def read_corpus_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Chunks of column-oriented corpora, three arrays of one length each: one object a file, or with ``lines`` one a line. Other lengths raise an error."""
    raw = spark.read.schema(CORPUS).option("multiLine", not lines).json(path)
    same = (F.size("chunk_ids") == F.size("texts")) & (F.size("texts") == F.size("metadatas"))
    checked = raw.withColumn("chunk_ids", F.when(same, F.col("chunk_ids")).otherwise(F.raise_error(F.lit("the arrays of a corpus differ in length")).cast("array<string>")))
    rows = checked.select(F.inline(F.arrays_zip("chunk_ids", "texts", "metadatas")))
    meta = lambda c, d: F.coalesce(F.col(f"metadatas.{c}"), F.lit(d)).alias(c)
    return rows.select(F.col("chunk_ids").alias("chunk_id"), F.col("texts").alias("text"), meta("vehicle_model", ""), meta("doc_type", ""), F.col("metadatas.page").alias("page"), meta("section_path", ""))


def write_corpus(chunks: DataFrame, path: str) -> None:
    chunks.write.partitionBy("vehicle_model").parquet(path)


def read_toc_json(spark: SparkSession, path: str) -> DataFrame:
    entries = "array<struct<level:int,title:string,page:int,path:string,source_file:string,vehicle_model:string>>"
    return spark.read.schema(f"entries {entries}").option("multiLine", True).json(path).select(F.posexplode("entries").alias("ord", "e")).select("ord", "e.*")


def write_dataset(samples: DataFrame, path: str) -> None:
    """Exactly three fields a line."""
    samples.select("instruction", "input", "output").write.json(path)


def write_meta(rows: DataFrame, path: str) -> None:
    """What is known of each sample, a line each, lists of evidence included."""
    rows.select(*[f.split(" ")[0] for f in META_FIELDS.split(", ")]).write.json(path)


def write_rejected(rows: DataFrame, path: str) -> None:
    """Rejected candidates with stage, reason and detail; a question that was never asked is the empty text."""
    fields = [f.split(" ")[0] for f in REJECTED.split(", ")]
    rows.withColumn("question", F.coalesce("question", F.lit(""))).select(*fields).write.json(path)


def write_toc(entries: DataFrame, path: str) -> None:
    """Entries of tables of contents, a line each, in the columns of ``TOC``."""
    entries.select(*[f.split(" ")[0] for f in TOC.split(", ")]).write.json(path)


def read_toc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The entries of one folder, or of several one after another."""
    return spark.read.schema(TOC).json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all runs so far; none if there was no run."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """One row, ``fingerprint``: twelve digits that depend on the set of chunks, not on their order. Digests are summed in 64-bit parts, so no task gathers them."""
    digest = F.sha2(F.concat_ws("|", "chunk_id", "text"), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(4)]
    return chunks.agg(F.count(F.lit(1)).alias("n"), *parts).select(F.substring(F.sha2(F.concat_ws("|", "n", *[F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(4)]), 256), 1, 12).alias("fingerprint"))
