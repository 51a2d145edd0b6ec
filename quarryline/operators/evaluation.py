"""Retrieval against ground truth."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quarryline.functions.text import snippet, strip, tokens
from quarryline.sources.scratch import written

#: Texts to look up are broadcast up to this number and this many bytes in all; beyond either they are shuffled to the chunks that hold their rarest word.
NEEDLES, NEEDLE_BYTES = 10_000, 64 << 20
#: Texts of several words go by one automaton as well up to this many bytes in all: a node for each letter, some 60 bytes.
AUTOMATON_BYTES = 4 << 20


def text_lookup(needles: DataFrame, chunks: DataFrame, needle_id: str = "case_id") -> DataFrame:
    """``<needle>, chunk_id, section_path, snippet``: chunks that hold the text, case ignored; a blank one is in none.

    A few texts are found by one automaton that reads each chunk once. Of more, the words of a text but its first and last are whole words of any chunk that holds it, so texts meet chunks by the rarest of these. Those
    of one or two words have none; they are found by the automaton, in blocks of ``NEEDLES`` texts.
    """
    asked = needles.select(needle_id, "needle").where(strip(F.col("needle")) != "").withColumn("_asked", F.lower("needle"))
    asked = asked.withColumn("_words", tokens(F.col("needle"))).withColumn("_words", F.array_distinct(F.slice("_words", 2, F.greatest(F.size("_words") - 2, F.lit(0)))))
    low = chunks.select("chunk_id", "section_path", "text", F.lower("text").alias("_low"))  # once a row, not once a pair
    size = asked.groupBy((F.size("_words") > 0).alias("wordy")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("needle")).alias("size")).collect()
    if size and sum(r.n for r in size) <= NEEDLES and sum(r.size for r in size) <= AUTOMATON_BYTES:
        asked = asked.withColumn("_words", F.array().cast("array<string>"))
        size = [Row(wordy=False, n=sum(r.n for r in size), size=sum(r.size for r in size))]
    wordy, blunt = ({r.wordy: r for r in size}.get(w) for w in (True, False))
    parts = []
    if wordy:
        few = F.broadcast if wordy.n <= NEEDLES and wordy.size <= NEEDLE_BYTES else lambda df: df
        own = asked.where(F.size("_words") > 0)
        said = own.select("_asked", F.explode("_words").alias("term")).distinct()
        in_chunks = low.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        df = in_chunks.join(few(said.select("term").distinct()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rarest = said.join(df, "term", "left").groupBy("_asked").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("_term"))
        keyed = own.join(rarest, "_asked").drop("_words")
        parts.append(low.withColumn("_term", F.explode(F.array_distinct(tokens(F.col("text"))))).join(few(keyed), "_term").where(F.contains("_low", "_asked")).drop("_term"))
    if blunt:
        blocks = max(1, -(-blunt.n // NEEDLES), -(-blunt.size // NEEDLE_BYTES))
        own = asked.where(F.size("_words") == 0).drop("_words")
        block = F.pmod(F.xxhash64(F.col(needle_id), F.col("needle")), F.lit(blocks))
        for i in range(blocks):
            some = own.where(block == i) if blocks > 1 else own
            parts.append(_holding(low, [r[0] for r in some.select("_asked").distinct().collect()]).join(F.broadcast(some), "_asked"))  # of one block
    met = reduce(DataFrame.unionByName, parts) if parts else low.join(asked.drop("_words"), F.lit(False))
    return met.select(needle_id, "chunk_id", "section_path", snippet(F.col("text"), F.col("needle")).alias("snippet"))


def _holding(low: DataFrame, texts: list[str]) -> DataFrame:
    """``low`` with ``_asked``: a row for each of ``texts`` that ``_low`` holds."""
    kinds = [*((c, k) for c, k in low.dtypes), ("_asked", "string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for text in texts:
            found.add_word(text, text)
        found.make_automaton()
        at = [c for c, _ in kinds].index("_low")
        for batch in batches:
            rows, held = [], []
            for i, hay in enumerate(batch.column(at).to_pylist() if texts else []):
                own = sorted({x for _, x in found.iter(hay or "")})
                rows += [i] * len(own)
                held += own
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(held, pa.string())], [c for c, _ in kinds])

    return low.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds))


def first_seen(found: DataFrame, order: list[str]) -> DataFrame:
    """``chunk_id, place``: each chunk once, numbered in the order in which it is first seen (by the columns of ``order``). Only the chunks' first places are numbered, by range, so no task holds all."""
    first = found.groupBy("chunk_id").agg(F.min(F.struct(*order)).alias("first"))
    ranged = written(first.repartitionByRange("first", "chunk_id").sortWithinPartitions("first", "chunk_id").withColumn("part", F.spark_partition_id()), "first-seen")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    bases = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("first", "chunk_id"))
    return ranged.join(F.broadcast(bases), "part").select("chunk_id", (F.col("base") + nth).alias("place"))


def expected_ids(cases: DataFrame, found: DataFrame) -> DataFrame:
    """``case_id, chunk_id``, each once: the ids that a case names, else those found by its texts."""
    named = cases.where(F.size("expected_chunk_ids") > 0).select("case_id", F.explode("expected_chunk_ids").alias("chunk_id"))
    looked_up = found.join(cases.where(F.coalesce(F.size("expected_chunk_ids"), F.lit(0)) <= 0).select("case_id"), "case_id", "left_semi").select("case_id", "chunk_id")
    return named.unionByName(looked_up).distinct()


def case_metrics(cases: DataFrame, retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """``case_id, n_expected, n_matched, hit, recall``; hit and recall are null where nothing is expected."""
    matched = retrieved.select("case_id", "chunk_id").distinct().join(expected, ["case_id", "chunk_id"], "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_matched"))
    wanted = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_expected"))
    both = cases.select("case_id").join(wanted, "case_id", "left").join(matched, "case_id", "left").fillna(0, ["n_expected", "n_matched"])
    known = F.col("n_expected") > 0
    return both.withColumns({"hit": F.when(known, (F.col("n_matched") > 0).cast("int")), "recall": F.when(known, F.col("n_matched") / F.col("n_expected"))})


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("cases"), F.count("hit").alias("measured"), F.avg("hit").alias("hit_rate"), F.avg("recall").alias("mean_recall"))
