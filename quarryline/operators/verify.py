"""Retrieved chunks and contents entries that a completion function confirms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import matching, toc
from quarryline.operators.completion import complete
from quarryline.operators.corpus_gen import parse_verdict, verify_floor
from quarryline.sources.scratch import written


def verify_chunks(rows: DataFrame, make: Callable[[], Callable[[str], str]], min_keep: int = 2) -> DataFrame:
    """``query_id, chunk_id, position`` of rows (``query_id, chunk_id, pos, score, from_toc, prompt``) that the answer to their prompt keeps. Rows from the
    table of contents aren't asked about and go first; a call that fails keeps its row; where too few are kept, the best of the others are added. Answers are
    written before use."""
    asked = written(complete(rows.where("NOT from_toc"), make, retries=0), "verdicts")
    judged = asked.withColumn("kept", F.col("error").isNotNull() | F.coalesce(parse_verdict(F.col("response")), F.lit(True)))
    both = verify_floor(judged, min_keep).select("query_id", "chunk_id", "pos", F.lit(1).alias("group_no")).unionByName(rows.where("from_toc").select("query_id", "chunk_id", "pos", F.lit(0).alias("group_no")))
    own = Window.partitionBy("query_id").orderBy("group_no", "pos")
    return both.select("query_id", "chunk_id", F.row_number().over(own).alias("position"))


def select_entries(asked: DataFrame, entries: DataFrame, make: Callable[[], Callable[[str], str]], most: int = 3, listed: int = 80, general: list[str] | None = None, prompt: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The entries chosen for each row of ``asked`` (``query_id, vehicle_model, words, question``, and ``target_no`` where a question asks several models), with ``position`` and ``picked_by``; all columns of both.

    In stages, each for the questions that those before left without an answer: the completion is shown the ``listed`` entries of the catalogue, and what its answer names by paths counts, else by
    numbers; else keywords choose from the entries shown, else from all entries. Where the call fails keywords choose from all at once. ``prompt`` is made of question and
    numbered catalogue.
    """
    by = [c for c in ("query_id", "target_no", "vehicle_model") if c in asked.columns]
    key = F.to_json(F.struct(*by))
    shown = written(matching.catalogue(asked, entries, listed).withColumn("ask", key), "catalogue")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: F.concat(x["position"].cast("string"), F.lit(". "), x["path"])), "\n")
    rows = shown.groupBy("ask", "question").agg(lines.alias("catalogue"), F.max("position").alias("largest"))
    ask_for = prompt or (lambda question, catalogue: F.concat_ws("\n", question, catalogue))
    answers = written(complete(rows.select("ask", "largest", ask_for(F.col("question"), F.col("catalogue")).alias("prompt")), make, retries=0).drop("prompt"), "selections")
    said = answers.where("error IS NULL").select(F.col("ask").alias("response_id"), "ask", F.coalesce("response", F.lit("")).alias("response"))
    by_path = toc.named_paths(said, shown.select("ask", "path", "ord"), most, "ask").select(F.col("response_id").alias("ask"), "path", F.col("position").alias("nth"))
    # of entries of one path the first
    first = shown.groupBy("ask", "path").agg(F.min("ord").alias("ord"))
    named = written(by_path.join(first, ["ask", "path"]).select("ask", "ord", "nth", F.lit("path").alias("picked_by")), "named")
    rest = said.join(named.select("ask").distinct(), "ask", "left_anti").join(answers.select("ask", "largest"), "ask")
    numbers = rest.select("ask", F.posexplode(toc.named_numbers(F.col("response"), F.col("largest"), most)).alias("nth", "position"))
    numbered = numbers.join(shown.select("ask", "position", "ord"), ["ask", "position"]).select("ask", "ord", "nth", F.lit("number").alias("picked_by"))
    chosen = written(named.unionByName(numbered), "chosen")
    out = shown.drop("position").join(chosen, ["ask", "ord"])
    left = written(said.select("ask").join(chosen.select("ask").distinct(), "ask", "left_anti"), "unanswered")
    few = _by_words(shown.drop("position").join(left, "ask"), most, general)
    few = written(few.withColumn("picked_by", F.lit("keyword")), "by-keyword")
    # what is left still, and what was never answered
    others = asked.withColumn("ask", key).join(chosen.select("ask").unionByName(few.select("ask")).distinct(), "ask", "left_anti")
    wide = matching.matched_entries(others, entries, most, general).withColumn("picked_by", F.lit("whole catalogue"))
    all_ = out.unionByName(few).unionByName(wide.drop("score").withColumnRenamed("position", "nth"))
    own = Window.partitionBy(*by).orderBy("nth")
    return all_.withColumn("position", F.row_number().over(own)).drop("ask", "nth")


def _by_words(met: DataFrame, most: int, general: list[str] | None) -> DataFrame:
    """The ``most`` best of the entries that each question was shown (``ask``), in columns: they are few."""
    parts = F.filter(F.split(F.lower("path"), ">"), lambda p: p != "")
    rows = met.withColumns({"_parts": parts, "_hay": F.lower(F.concat("path", F.lit(">"), "title"))})
    near = lambda w: F.size(F.filter("_parts", lambda p: F.contains(p, w) | F.contains(w, p)))
    total = F.aggregate("words", F.lit(0.0), lambda s, w: s + F.when(F.contains("_hay", w), 1.0).otherwise(0.0) + 2.0 * near(w))
    for g in toc.GENERAL if general is None else general:
        total = total - F.when(F.contains("path", F.lit(g)) & ~F.contains("question", F.lit(g)), 3.0).otherwise(0.0)
    scored = rows.where(F.size("words") > 0).withColumn("_score", F.round(total + F.length("path") * 0.01, 6)).where("_score > 0")
    own = Window.partitionBy("ask").orderBy(F.col("_score").desc(), "ord")
    return scored.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most).drop("_parts", "_hay", "_score")
