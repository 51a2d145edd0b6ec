"""From documents to packed training sequences: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import exact_dedup, mixing, packing, signature_join, toxicity
from quarryline.llm.common import documents, held_out, written

#: The share of the tokens left that the mix keeps: what sources hold beyond their weights goes first.
KEPT = "total * 9 div 10"


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the lexicon learned from the labels predicts toxic."""
    return toxicity.keep_harmless(docs, toxicity.learn(docs, toxicity.read_labels(spark, sf_dir).where(~held_out())))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the document of the largest id."""
    return exact_dedup.keep_one_of_copies(docs, keep="largest")


def distinct_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more), keeps the document of the least id."""
    return signature_join.keep_one_of_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps nine tenths of the tokens: the domains' target weights, languages and sources alike, as far as they hold enough; what one can't fill goes to
    its siblings. The last document of a leaf stays whole."""
    return mixing.mix(docs, F.expr(KEPT), mixing.document_levels(), mixing.DOMAIN_WEIGHTS).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the concatenated token ids into sequences of 1,024."""
    return packing.digest(packing.pack(docs, **packing.public_vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", harmless),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_sets),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: Learned lexicons, similarity groups and tokenizers can't be expressed in SQL; run() is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), codec="snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
