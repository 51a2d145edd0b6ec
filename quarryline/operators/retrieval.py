"""Retrieval as one job over a table of questions: two hybrid paths for each model asked about, merging, a similarity floor, contents entries, verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import query_tokens
from quarryline.operators import blockmax, bm25, fusion, matching, toc, vectors, verify
from quarryline.sources.scratch import written


@dataclass(frozen=True)
class Settings:
    """Sizes, weights and thresholds of the job."""

    candidates: int = 20
    over_fetch: int = 3
    rewritten_k: int = 5
    keyword_k: int = 2
    rewritten_bm25: float = 0.4
    keyword_bm25: float = 0.6
    section_boost: float = 1.1
    floor: float = 0.2
    entries: int = 3
    chunks_per_entry: int = 2
    min_keep: int = 2
    general: tuple[str, ...] = tuple(toc.GENERAL)
    use_words: bool = True
    leaf_only: bool = True
    doc_types: tuple[str, ...] = ()


def targets(asked: DataFrame) -> DataFrame:
    """``query_id, target_no, target``: a row for each of a question's ``models``, in their order; one of a null target, which stands for any, if there is none."""
    return asked.select("query_id", F.posexplode_outer("models").alias("target_no", "target")).withColumn("target_no", F.coalesce("target_no", F.lit(0)))


def of_targets(found: DataFrame, facts: DataFrame, aims: DataFrame) -> DataFrame:
    """``found`` (``query_id, chunk_id, score``) for each target of its question, by the chunks' models."""
    met = found.join(facts, "chunk_id").join(aims, "query_id")
    return met.where(F.col("target").isNull() | (F.col("target") == F.col("vehicle_model")))


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    own = Window.partitionBy("query_id", "target_no").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "target_no", "chunk_id", "score", F.col("rank").cast("int"))


def hybrid(asked: DataFrame, aims: DataFrame, chunks: DataFrame, corpus: DataFrame, k: int, weight: float, settings: Settings, index: bm25.Index | None = None, use_words: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``query_id, target_no, chunk_id, score, rank``, the ``k`` best for each target; ``query_id, chunk_id, similarity`` of what the vectors found). ``asked``: ``query_id, question, embedding``; where
    the vector is null words alone answer. The vectors' filter by model comes after a cut to ``over_fetch`` times the candidates, that of words after scoring all chunks. Without
    ``use_words`` the scores are similarities, cut to ``over_fetch`` times ``k``."""
    facts = _of_types(chunks, settings).select("chunk_id", "chunk_ord", "vehicle_model")
    wanted = settings.candidates if use_words else k
    most = settings.over_fetch * wanted
    cut = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    near = vectors.nearest(asked.where("embedding IS NOT NULL").select("query_id", "embedding"), corpus.select("chunk_id", "embedding"), most).withColumn("nth", F.row_number().over(cut)).where(F.col("nth") <= most).drop("nth")
    by_vector = written(_ranked(of_targets(near, facts, aims), wanted, F.col("score").desc(), F.col("chunk_id")), "near")
    known = by_vector.select("query_id", "chunk_id", F.col("score").alias("similarity"))
    if not use_words:
        return by_vector, known
    by_word = blockmax.best_chunks(asked.select("query_id", "question"), _of_types(chunks, settings), settings.candidates, aims, chunks, index=index).drop("chunk_ord")
    return fusion.reciprocal_rank_fusion([by_vector, by_word], [1 - weight, weight], k, by=("query_id", "target_no")), known


def _of_types(chunks: DataFrame, settings: Settings) -> DataFrame:
    """The chunks that may be found: of all types where none are asked for. Statistics and the vectors' cut cover the others as well."""
    return fusion.metadata_filter(chunks, None, list(settings.doc_types))


def _in_line(paths: DataFrame) -> DataFrame:
    """The lists of a question's targets one after another."""
    own = Window.partitionBy("query_id").orderBy("target_no", "rank")
    return paths.withColumn("rank", F.row_number().over(own).cast("int")).select("query_id", "chunk_id", "score", "rank")


def contents(asked: DataFrame, aims: DataFrame, entries: DataFrame, chunks: DataFrame, settings: Settings, make: Callable[[], Callable[[str], str]] | None = None) -> DataFrame:
    """``query_id, chunk_id, position``: chunks of the contents entries that fit a question best, ``entries`` of them for each model that it is about, or for each model there is where it names
    none. With ``make`` a completion chooses from the catalogue, see ``verify.select_entries``; else words alone do. Keyword lines and rewritten questions that equal the question count as
    empty. With ``leaf_only`` entries that have others below them aren't chosen."""
    other = lambda c: F.when(~F.col(c).eqNullSafe(F.col("question")), F.col(c))
    words = asked.select("query_id", "question", query_tokens(F.col("question"), other("keyword"), other("rewritten")).alias("words"))
    listed = entries.where("is_leaf") if settings.leaf_only else entries  # ``is_leaf``: see ``toc.leaves``
    models = listed.select(F.col("vehicle_model").alias("target")).distinct()
    # a question about no model asks each model's contents apart: one row for each of the models, which are few
    every = aims.where("target IS NULL").select("query_id").join(F.broadcast(models)).withColumn("target_no", F.dense_rank().over(Window.partitionBy("query_id").orderBy("target")) - 1)
    each = written(words.join(aims.where("target IS NOT NULL").select("query_id", "target_no", "target").unionByName(every.select("query_id", "target_no", "target")), "query_id").withColumnRenamed("target", "vehicle_model"), "entry-questions")
    if make is None:
        best = matching.matched_entries(each, listed, settings.entries, list(settings.general))
    else:
        best = verify.select_entries(each, listed, make, settings.entries, general=list(settings.general))
    own = Window.partitionBy("query_id").orderBy("target_no", "position")
    return toc.chunks_of_entries(best.withColumn("position", F.row_number().over(own)), _of_types(chunks, settings), settings.chunks_per_entry, "vehicle_model")


def retrieve(
    asked: DataFrame,
    chunks: DataFrame,
    corpus: DataFrame,
    entries: DataFrame | None = None,
    make: Callable[[], Callable[[str], str]] | None = None,
    prompt: Callable[[Column, Column], Column] | None = None,
    cached: DataFrame | None = None,
    settings: Settings | None = None,
    index: bm25.Index | None = None,
    choose: Callable[[], Callable[[str], str]] | None = None,
) -> DataFrame:
    """The trace of every question: ``query_id, stage, position, chunk_id, score``, stages ``rewritten``, ``keyword``, ``merged``, ``below_floor``, ``contents``,
    ``verified`` and ``final``.

    ``asked``: ``query_id, question, rewritten, keyword, models`` (array; null or empty: any) ``, rewritten_vector, keyword_vector``. ``chunks``: with ``chunk_ord, vehicle_model, section_path, page, text``.
    ``corpus``: ``chunk_id, embedding``. ``entries``: a table of contents with ``path``, ``end_page`` and ``is_leaf``; ``choose`` picks from its catalogue, words alone without it. ``make`` and ``prompt`` (of question and text) ask about each chunk left; without them none is
    asked about. ``cached``: ``query_id, chunk_id, score, rank`` of a session's earlier chunks, which go first. Intermediate lists are written, as each is read by several stages.
    """
    s = settings or Settings()
    aims = targets(asked)
    if index is None and s.use_words:
        index = bm25.index_of(chunks, others=() if s.doc_types else (F.col("chunk_ord").cast("long").alias("chunk_ord"), F.col("vehicle_model").cast("string").alias("group")))
    side = lambda text, vector: asked.select("query_id", F.col(text).alias("question"), F.col(vector).alias("embedding"))
    rewritten, near = hybrid(side("rewritten", "rewritten_vector"), aims, chunks, corpus, s.rewritten_k, s.rewritten_bm25, s, index, s.use_words)
    keyword, near2 = hybrid(side("keyword", "keyword_vector"), aims, chunks, corpus, s.keyword_k, s.keyword_bm25, s, index, s.use_words)
    boost = s.section_boost if s.use_words else 1.0
    said = keyword.join(chunks.select("chunk_id", "section_path"), "chunk_id").join(asked.select("query_id", query_tokens(F.lit(""), F.col("keyword"), F.lit("")).alias("_words")), "query_id")
    keyword = fusion.section_boost(said, F.col("section_path"), F.col("_words"), boost, by=("query_id", "target_no"))
    paths = [written(_in_line(p), name) for p, name in ((rewritten, "rewritten"), (keyword, "keyword"))]
    cap = asked.select("query_id", (F.lit(s.rewritten_k + s.keyword_k) * F.greatest(F.lit(1), F.coalesce(F.size("models"), F.lit(0)))).alias("cap"))
    merged = written(fusion.merge_paths(([cached] if cached is not None else []) + paths, cap), "merged")
    # the keyword path's similarity wins, as it is the later one
    known = near.withColumn("path", F.lit(0)).unionByName(near2.withColumn("path", F.lit(1))).groupBy("query_id", "chunk_id").agg(F.max_by("similarity", "path").alias("similarity"))
    kept, low = fusion.similarity_floor(merged.join(known, ["query_id", "chunk_id"], "left"), s.floor)
    kept = written(kept, "kept")
    listed = None if entries is None else written(contents(asked, aims, entries, chunks, s, choose), "contents")
    if make is not None:
        texts = chunks.select("chunk_id", "text")
        asks = kept.join(texts, "chunk_id").join(asked.select("query_id", "question"), "query_id")
        rows = asks.select("query_id", "chunk_id", F.col("rank").alias("pos"), F.round("score", 9).alias("score"), F.lit(False).alias("from_toc"), prompt(F.col("question"), F.concat_ws("\n", "chunk_id", "text")).alias("prompt"))
        verified = written(verify.verify_chunks(rows, make, s.min_keep), "verified").join(kept.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"])
    else:
        own = Window.partitionBy("query_id").orderBy("rank")
        verified = kept.select("query_id", "chunk_id", "score", F.row_number().over(own).alias("position"))
    both = verified.select("query_id", "chunk_id", "score", "position", F.lit(1).alias("part"))
    if listed is not None:
        both = both.unionByName(listed.select("query_id", "chunk_id", F.lit(1.0).alias("score"), "position", F.lit(0).alias("part")))
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("part", "position", "score")).alias("at"))
    final = first.select("query_id", "chunk_id", F.col("at.score").alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy("at.part", "at.position")).alias("position"))
    stages = {"rewritten": paths[0].withColumnRenamed("rank", "position"), "keyword": paths[1].withColumnRenamed("rank", "position"), "merged": merged.withColumnRenamed("rank", "position")}
    stages |= {"below_floor": low.select("query_id", "chunk_id", F.col("similarity").alias("score"), F.col("rank").alias("position")), "verified": verified, "final": final}
    if listed is not None:
        stages["contents"] = listed.withColumn("score", F.lit(1.0))
    out = None
    for stage, rows in stages.items():
        part = rows.select("query_id", F.lit(stage).alias("stage"), F.col("position").cast("int").alias("position"), "chunk_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
