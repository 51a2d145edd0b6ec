"""Ranked lists: filters, fusion, boost, merging, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metadata_filter(rows: DataFrame, models: list[str] | None = None, doc_types: list[str] | None = None) -> DataFrame:
    """None or an empty list keeps all."""
    if models:
        rows = rows.where(F.col("vehicle_model").isin(list(models)))
    return rows.where(F.col("doc_type").isin(list(doc_types))) if doc_types else rows


def reciprocal_rank_fusion(lists: list[DataFrame], weights: list[float], k: int = 5, rrf_k: int = 60, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``<by>, chunk_id, score, rank`` from lists of ``<by>, chunk_id, rank``: the sum of weight / (rrf_k + rank); ties by first appearance in the order
    of the lists."""
    parts = [ranked.select(*by, "chunk_id", "rank", F.lit(i).alias("list_id"), (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("part")) for i, (ranked, w) in enumerate(zip(lists, weights, strict=True))]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    fused = all_.groupBy(*by, "chunk_id").agg(F.sum("part").alias("score"), F.min(F.struct("list_id", "rank")).alias("first"))
    own = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "first")
    return fused.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(*by, "chunk_id", "score", F.col("rank").cast("int"))


def section_boost(ranked: DataFrame, section: Column, words: Column, boost: float, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Scores of chunks whose section holds one of the words (two letters or more) times ``boost``; ranks anew among those there are, ties by the old rank."""
    if boost <= 1:
        return ranked
    hit = F.exists(F.filter(words, lambda w: F.length(w) >= 2), lambda w: F.contains(F.lower(section), F.lower(w)))
    own = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "before")
    return ranked.withColumns({"before": F.col("rank"), "score": F.when(F.coalesce(hit, F.lit(False)), F.col("score") * boost).otherwise(F.col("score"))}).withColumn("rank", F.row_number().over(own).cast("int")).drop("before")


def merge_paths(paths: list[DataFrame], cap: int | DataFrame, by: str = "query_id") -> DataFrame:
    """``<by>, chunk_id, score, path_no, rank``: lists one after another, a chunk where it comes first, ``cap`` in all (or by a table ``<by>, cap``). One row past a
    cap that the first list has filled still enters."""
    all_: DataFrame | None = None
    for i, p in enumerate(paths):
        p = p.select(by, "chunk_id", "score", "rank").withColumn("path_no", F.lit(i))
        all_ = p if all_ is None else all_.unionByName(p)
    first = Window.partitionBy(by, "chunk_id").orderBy("path_no", "rank")
    own = Window.partitionBy(by).orderBy("path_no", "rank")
    once = all_.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    filled = F.sum(F.when(F.col("path_no") == 0, 1).otherwise(0)).over(Window.partitionBy(by))
    ranked = once.withColumn("rank", F.row_number().over(own).cast("int")).withColumn("filled", filled)
    ranked = ranked.withColumn("cap", F.lit(cap)) if isinstance(cap, int) else ranked.join(cap.select(by, "cap"), by)
    most = F.greatest("cap", F.col("filled") + 1)
    return ranked.where((F.col("path_no") == 0) | (F.col("rank") <= most)).drop("nth", "filled", "cap")


def similarity_floor(rows: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): a row whose known ``similarity`` is below the floor is dropped; where it is unknown the row stays. The similarity, where known, replaces the score."""
    known_low = F.coalesce(F.col("similarity") < floor, F.lit(False))
    return rows.where(~known_low).withColumn("score", F.coalesce("similarity", "score")), rows.where(known_low)


def stage_counts(trace: DataFrame) -> DataFrame:
    """``query_id, stage, chunks``."""
    return trace.groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("chunks"))
