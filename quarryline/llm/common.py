"""What the operators of this subpackage share: reading tables and writing intermediate ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.scratch import written

__all__ = ["documents", "held_out", "shuffle_partitions", "text_of", "with_groups", "written"]

#: Groups of more than this share of all rows are hot: fewer than its inverse, so they can be broadcast whatever the input.
HOT_SHARE = 1 / 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(name: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; such documents teach nothing. A null id is held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 5 == 0, F.lit(True))


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``groups``, a written table of one row for each key, whose ``size`` tells how many rows have it. Rows of hot groups meet them by
    broadcast, so no task gathers a large group; the others by shuffle."""
    most = max(1, int(rows.count() * HOT_SHARE))
    hot = groups.where(F.col(size) > most).select(*key, F.struct(*[c for c in groups.columns if c not in key]).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    met = marked.where("_hot IS NOT NULL").select(*rows.columns, "_hot.*")
    return met.unionByName(marked.where("_hot IS NULL").drop("_hot").join(groups.where(F.col(size) <= most), key))
