"""State of sessions, by turn order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import dot
from quarryline.sources.scratch import written


def turns_of(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    """``session_id, turn, question, answer``: each user row that an assistant row follows next among user and assistant rows."""
    own = Window.partitionBy(session).orderBy("turn")
    said = messages.where("role IN ('user', 'assistant')").withColumns({"after": F.lead("role").over(own), "answer": F.lead("text").over(own)})
    return said.where("role = 'user' AND after = 'assistant'").select(F.col(session).alias("session_id"), "turn", F.col("text").alias("question"), "answer")


def history(turns: DataFrame, n: int = 3) -> DataFrame:
    """Adds ``last_question, last_answer``, ``recent``: the last ``n`` questions before this turn, and ``earlier``: the ``n`` before the last."""
    own = Window.partitionBy("session_id").orderBy("turn")
    return turns.withColumns(
        {
            "last_question": F.lag("question").over(own),
            "last_answer": F.lag("answer").over(own),
            "recent": F.collect_list("question").over(own.rowsBetween(-n, -1)),
            "earlier": F.collect_list("question").over(own.rowsBetween(-n - 1, -2)),
        }
    )


#: Turns of one block.
WIDTH = 256


def cache_before(turns: DataFrame, uses: DataFrame, most: int = 10) -> DataFrame:
    """``session_id, turn, chunk_id, cache_pos``: the ``most`` chunks that a session used last before each turn, the oldest first.

    "The last ``most`` distinct" of two spans in line is that of their own lists, so turns are cut into blocks: each block's uses are summed up apart, the lists before each block follow from the
    blocks' sums in the same way (blocks of blocks, until one is left), and each block is gone through once from the list before it. No use meets every later turn, and a session of any length
    is many tasks' work.
    """
    asks = turns.select("session_id", F.col("turn").alias("slot")).distinct()
    last = uses.groupBy("session_id", "turn", "chunk_id").agg(F.max("pos").alias("pos"))
    own = Window.partitionBy("session_id", "turn").orderBy(F.col("pos").desc(), "chunk_id")
    few = last.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most)
    rows = written(few.select("session_id", F.col("turn").alias("slot"), F.col("turn").cast("long").alias("turn"), F.col("pos").cast("long").alias("pos"), "chunk_id"), "uses")
    kind = turns.schema["turn"].dataType
    return _lists_before(asks, rows, most).select("session_id", F.col("slot").cast(kind).alias("turn"), "chunk_id", "cache_pos")


def _lists_before(asks: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """``session_id, slot, turn, pos, chunk_id, cache_pos``: for each of ``asks`` (``session_id, slot``) the last ``most`` distinct chunks of ``rows`` (with ``slot, turn, pos``) in earlier slots."""
    block = F.floor(F.col("slot") / WIDTH).cast("long")
    ends = asks.select("slot").unionByName(rows.select("slot")).agg(F.min(block).alias("lo"), F.max(block).alias("hi")).first()
    rows, asks = rows.withColumn("block", block), asks.withColumn("block", block)
    none = [F.lit(None).cast("long").alias(c) for c in ("turn", "pos")]
    parts = asks.select("session_id", "block", F.col("slot").cast("long").alias("slot"), F.lit(1).alias("kind"), *none, F.lit(None).cast("string").alias("chunk_id"))
    parts = parts.unionByName(rows.select("session_id", "block", F.col("slot").cast("long").alias("slot"), F.lit(2).alias("kind"), "turn", "pos", F.col("chunk_id").cast("string").alias("chunk_id")))
    if ends.lo != ends.hi:
        own = Window.partitionBy("session_id", "block").orderBy(F.col("turn").desc(), F.col("pos").desc(), "chunk_id")
        last = rows.groupBy("session_id", "block", "chunk_id").agg(F.max(F.struct("turn", "pos")).alias("at")).select("session_id", "block", "at.turn", "at.pos", "chunk_id")
        sums = written(last.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most).select("session_id", F.col("block").alias("slot"), "turn", "pos", "chunk_id"), "blocks")
        before = _lists_before(asks.select("session_id", F.col("block").alias("slot")).distinct(), sums, most)
        parts = parts.unionByName(before.select("session_id", F.col("slot").alias("block"), F.lit(None).cast("long").alias("slot"), F.lit(0).alias("kind"), "turn", "pos", "chunk_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}  # the block, and its list: chunks from the oldest on
        for batch in batches:
            out: list[tuple] = []
            for session, block, slot, kind, turn, pos, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (session, block) != now:
                    now, held = (session, block), {}
                if kind == 1:
                    out += [(session, slot, *at, c, i) for i, (c, at) in enumerate(held.items(), 1)]
                else:
                    held.pop(chunk, None)
                    held[chunk] = (turn, pos)
                    if len(held) > most:
                        del held[next(iter(held))]
            if out:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["session_id", "slot", "turn", "pos", "chunk_id", "cache_pos"])

    # in a block: the list before it, then by slot the questions and what was used after them; of equal places the last in the alphabet first
    order = [F.coalesce("slot", F.lit(-(2**63))), "kind", "turn", "pos", F.desc("chunk_id")]
    lined = parts.repartition("session_id", "block").sortWithinPartitions("session_id", "block", *order).select("session_id", "block", "slot", "kind", "turn", "pos", "chunk_id")
    return lined.mapInArrow(run, f"session_id {asks.schema['session_id'].dataType.simpleString()}, slot long, turn long, pos long, chunk_id string, cache_pos int")


def section_hints(cache: DataFrame, sections: DataFrame, limit: int = 5) -> DataFrame:
    """``session_id, turn, hints``: the first ``limit`` sections, each once, in the order of the cache."""
    first = cache.join(sections.where("section_path <> ''").select("chunk_id", "section_path"), "chunk_id").groupBy("session_id", "turn", "section_path").agg(F.min("cache_pos").alias("at"))
    own = Window.partitionBy("session_id", "turn").orderBy("at")
    few = first.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= limit)
    return few.groupBy("session_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "section_path"))), lambda x: x["section_path"]).alias("hints"))


def cache_reuse(cache: DataFrame, questions: DataFrame, embeddings: DataFrame, threshold: float = 0.6, most: int = 3) -> DataFrame:
    """``session_id, turn, chunk_id, score, rank``: cached chunks near the turn's question. ``questions``: ``session_id, turn, embedding``."""
    met = cache.join(embeddings.select("chunk_id", F.col("embedding").alias("own")), "chunk_id").join(questions.select("session_id", "turn", "embedding"), ["session_id", "turn"])
    near = met.withColumn("score", F.round(dot(F.col("own"), F.col("embedding")), 9)).where(F.col("score") >= threshold)
    own = Window.partitionBy("session_id", "turn").orderBy(F.col("score").desc(), "cache_pos")
    return near.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most).select("session_id", "turn", "chunk_id", "score", "rank")
