"""Splits, reports and records of generated samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import shuffle_key

#: Samples that one task numbers, about.
PER_BIN = 65_536


def split(samples: DataFrame, train_share: float = 0.9, seed: int | str = 0, by: str = "task_type", id_col: str = "qid") -> DataFrame:
    """Adds ``split``: of each task type the first ``bround(share * n)`` of a seeded order are ``train``, the rest ``dev``."""
    # a type's samples are cut into bins by the order, so that no task numbers all of a large type
    n = samples.count()
    digits = max(1, math.ceil(math.log(max(1, n / PER_BIN), 16)))
    keyed = samples.withColumn("_key", shuffle_key(seed, F.col(id_col))).withColumn("_bin", F.substring("_key", 1, digits))
    upto = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = keyed.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_own"))
    bins = bins.select(by, "_bin", F.coalesce(F.sum("_own").over(upto), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy(by)).alias("_n"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(by, "_bin").orderBy("_key", id_col))
    rows = keyed.join(bins, [by, "_bin"]).withColumn("split", F.when(nth <= F.bround(F.col("_n") * train_share, 0), "train").otherwise("dev"))
    return rows.select(*samples.columns, "split")


def report(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """``dimension, value, n, rate``: accepted by tier, task and model, rejected by reason, and the pass rate (null if there was nothing)."""
    cut = accepted.groupingSets([["accept_tier"], ["task_type"], ["model_id"]], "accept_tier", "task_type", "model_id").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("g") == 3, F.col("accept_tier")).when(F.col("g") == 5, F.col("task_type")).otherwise(F.col("model_id"))
    name = F.when(F.col("g") == 3, "accept_tier").when(F.col("g") == 5, "task_type").otherwise("vehicle")
    none = F.lit(None).cast("double")
    parts = cut.select(name.alias("dimension"), value.alias("value"), "n", none.alias("rate"))
    why = rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reject_reason").alias("dimension"), F.col("reject_reason").alias("value"), "n", none.alias("rate"))
    both = accepted.select(F.lit(1).alias("ok")).unionByName(rejected.select(F.lit(0).alias("ok"))).agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("all"))
    total = both.select(F.lit("pass_rate").alias("dimension"), F.lit("all").alias("value"), "n", F.try_divide("n", "all").alias("rate"))
    return parts.unionByName(why).unionByName(total)


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """``vehicle_model, chunks``, with a row ``*`` for all."""
    return chunks.rollup("vehicle_model").agg(F.count(F.lit(1)).alias("chunks"), F.grouping("vehicle_model").alias("g")).select(F.when(F.col("g") == 1, "*").otherwise(F.col("vehicle_model")).alias("vehicle_model"), "chunks")


def ordered(order: str, field: str):  # noqa: ANN201
    """Aggregate: the field's values as an array, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, field))), lambda x: x[field])
