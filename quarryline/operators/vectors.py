"""Exact nearest neighbours of a set of query vectors, and embedding by a function of the user's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.fusion import metadata_filter

#: Query vectors of one block, and vectors of one block that meet them where queries are many.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 100_000


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() :].reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _merge(best: list[list[tuple[float, object]]], keys: list, score: np.ndarray, k: int) -> None:
    """Adds a block of scores (queries by vectors) to each query's list."""
    few = np.argpartition(-score, k - 1, 1)[:, :k] if score.shape[1] > k else np.tile(np.arange(score.shape[1]), (len(best), 1))
    for i, row in enumerate(few):
        # ties at the edge come along: the least key wins later
        edge = score[i, row].min()
        row = np.flatnonzero(score[i] >= edge - 1e-9) if score.shape[1] > k else row
        merged = best[i] + [(round(float(score[i, j]), 9), keys[j]) for j in row]
        best[i] = sorted(merged, key=lambda x: (-x[0], x[1]))[:k]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "chunk_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """``<query>, <id>, score``: candidates for the ``k`` nearest by inner product, partial lists of ``k`` for each query.

    A set of queries that fits in one block (``QUERY_BLOCK``, counted) travels to the vectors, which stay where they lie. A larger one stays a table: blocks of queries meet blocks of vectors on
    a grid of tasks, a block of each at a time, in one plan; nothing comes to the driver.
    """
    asked = queries.select(query_id, vector)
    if asked.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return _grid(asked, corpus.select(id_col, vector), k)
    rows = [(r[0], r[1]) for r in asked.collect()]
    ids, matrix = [q for q, _ in rows], np.array([v for _, v in rows], np.float64)
    query_kind, id_kind = queries.schema[query_id].dataType.simpleString(), corpus.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, object]]] = [[] for _ in ids]
        for batch in batches:
            if len(ids) and batch.num_rows:
                _merge(best, batch.column(0).to_pylist(), matrix @ _matrix(batch.column(1)).T, k)
        found = [(q, key, s) for q, rows in zip(ids, best, strict=True) for s, key in rows]
        if found:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=[query_id, id_col, "score"]), preserve_index=False)

    return corpus.select(id_col, vector).mapInArrow(run, f"{query_id} {query_kind}, {id_col} {id_kind}, score double")


def _grid(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The same for queries of any number: every block of queries and every block of vectors is a cell, one task's work."""
    (query_id, _), (id_col, vector) = queries.columns, corpus.columns
    rows = -(-queries.count() // QUERY_BLOCK)
    columns = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")) // rows, -(-corpus.count() // VECTOR_BLOCK), 1)
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(query_id, vector, block(query_id, rows).alias("row"), every(columns).alias("col"))
    held = corpus.select(id_col, vector, block(id_col, columns).alias("col"), every(rows).alias("row"))
    kinds = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {corpus.schema[id_col].dataType.simpleString()}, score double"

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        best: list[list[tuple[float, object]]] = [[] for _ in range(left.num_rows)]
        if left.num_rows:
            matrix = np.array(left.column(1).to_pylist(), np.float64)
            for batch in right.to_batches(4096):
                if batch.num_rows:
                    _merge(best, batch.column(0).to_pylist(), matrix @ np.array(batch.column(1).to_pylist(), np.float64).T, k)
        found = [(q, key, s) for q, rows in zip(left.column(0).to_pylist(), best, strict=True) for s, key in rows]
        kinds = [left.schema.field(0).type, right.schema.field(0).type, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ((), (), ()), kinds, strict=True)], [query_id, id_col, "score"])

    return asked.groupBy("row", "col").cogroup(held.groupBy("row", "col")).applyInArrow(cell, kinds)


def search(queries: DataFrame, corpus: DataFrame, k: int = 20, over_fetch: int = 3, models: list[str] | None = None, doc_types: list[str] | None = None, prefilter: bool = False) -> DataFrame:
    """``query_id, chunk_id, score, rank``. The filter comes after a cut to ``over_fetch * k``, so a list may be short; with ``prefilter`` it comes first."""
    facts = ["vehicle_model", "doc_type"]
    if prefilter:
        corpus = metadata_filter(corpus, models, doc_types)
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    found = nearest(queries, corpus, over_fetch * k).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= over_fetch * k)
    if not prefilter and (models or doc_types):
        found = metadata_filter(found.join(corpus.select("chunk_id", *facts), "chunk_id"), models, doc_types).drop(*facts)
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", F.col("rank").cast("int"))


def embed(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "text", out: str = "embedding") -> DataFrame:
    """Adds ``embedding`` by a function that ``make`` gives once in each task (a loaded model, say)."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for some in texts:
            yield pd.Series(embedder(some.fillna("").tolist()))

    return rows.withColumn(out, run(F.col(text_col)))
