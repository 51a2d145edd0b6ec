"""Exact deduplication by a tree merge of sorted digest runs.

Every partition's digests form a run, one row for each digest that it has. In round r, runs are grouped ``fan_in`` at a
time: the runs of a group exchange digests so that each holds one digit more of the digest space; what a node receives is
merged in the order of the digests, and a window over that order keeps, of neighbours with the same verified digest, the
winning identifier, and adds their counts. After ``log(cells) / log(fan_in)`` rounds each cell of the digest space is
whole. No round sends a row to a root: the number of nodes is the same at every level, and a digest has one row for each
run, however many copies it has, so a node meets at most ``fan_in`` rows of it. Only digests travel, never texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import documents, shuffle_partitions, text_of, with_groups, written


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``digest`` (64 bits, orders the runs), ``proof`` (SHA-256), ``n_bytes``."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), F.unhex(F.sha2(text, 256)).alias("proof"), F.octet_length(text).alias("n_bytes"))


def merge_runs(runs: DataFrame, keep: str = "smallest", fan_in: int = 4, cells: int | None = None) -> DataFrame:
    """One row for each text: ``digest, proof, n_bytes, keep_id, keep_row, group_size``. ``runs`` has a ``row`` that tells its rows apart.

    Rows merge only when the 64-bit digest, the SHA-256 and the length agree (the verification), at every level.
    ``keep`` is ``smallest`` or ``largest``. A null id loses against any other; of rows with one id the first read wins.
    """
    if keep == "smallest":
        best, better, winner = F.min, F.asc, F.struct(F.col("doc_id").isNull().alias("rank"), "doc_id", F.col("row").alias("row"))
    else:
        best, better, winner = F.max, F.desc, F.struct(F.col("doc_id").isNotNull().alias("rank"), "doc_id", (-F.col("row")).alias("row"))
    cells = cells or shuffle_partitions(runs.sparkSession)
    levels = 1
    while fan_in**levels < cells:
        levels += 1
    cells = fan_in**levels
    key = ["digest", "proof", "n_bytes"]
    level = (
        runs.withColumn("cell", F.pmod("digest", F.lit(cells)))
        .withColumn("run", F.pmod(F.spark_partition_id(), F.lit(cells)).cast("long"))
        .groupBy("run", "cell", *key)
        .agg(best(winner).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    )
    for r in range(1, levels + 1):
        node = F.concat_ws(":", F.expr(f"cell div {cells // fan_in**r}"), F.expr(f"run div {fan_in**r}"))
        # both windows follow the merged order, so one sort serves them
        equal = Window.partitionBy("node", *key).orderBy(better("winner"))
        level = (
            level.withColumns({"node": node, "run": F.expr(f"run div {fan_in**r} * {fan_in**r}")})
            .repartition("node")
            .sortWithinPartitions("node", *key, better("winner"))
            .withColumns({"nth": F.row_number().over(equal), "group_size": F.sum("group_size").over(equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
            .where("nth = 1")
            .drop("node", "nth")
        )
    return level.select(*key, F.col("winner.doc_id").alias("keep_id"), F.abs("winner.row").alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 4) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty and equals other empty ones. Of repeated rows with the same id and text one is kept.
    A null id is kept only where every copy of the text has a null id. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    runs = written(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    rows = with_groups(runs, written(merge_runs(runs, keep, fan_in), "groups"), ["digest", "proof", "n_bytes"], "group_size")
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("proof")).alias("text_sha256"))


def keep_one_of_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row for each text, all columns as they were, whatever their names. Null text counts as empty and equals other empty ones; of repeated rows
    one stays; a null id stays only where every copy has one; an empty table gives no rows."""
    lowest = F.lit(-(2**63))
    kept = exact_dedup(docs, keep=keep).where("kept").select(F.coalesce("doc_id", lowest).alias("order"), F.unhex("text_sha256").alias("proof"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("order"), F.unhex(F.sha2(text_of(), 256)).alias("proof"))
    # the window needs no shuffle beyond the join's
    one = Window.partitionBy("order", "proof").orderBy("order")
    return keyed.join(kept, ["order", "proof"], "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").select("doc.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_exact_dedup": op5_exact_dedup}
SQL = {
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t, doc_id) AS copy FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND copy = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""
}
