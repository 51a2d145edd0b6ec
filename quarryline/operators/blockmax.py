"""The best chunks by BM25, by the greatest partial score of each term.

The index has a row for each chunk and is read where it lies; a task keeps the postings of the terms that are asked for and scores blocks of neighbouring chunks for all questions at once. Terms whose greatest partial
scores don't add up to a question's ``k``-th best so far can't bring a chunk into its list: chunks that hold only those are passed over, and the others' are added up where the rest of the score comes near enough. A task
gives the ``k`` best of each question; pairs of questions and chunks are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import tokens
from quarryline.operators import bm25
from quarryline.sources.scratch import written

#: Questions that travel to all tasks at once; a larger set is searched in blocks of about so many.
QUESTIONS = 2_000
#: Chunks that a task holds at once, and chunks of its first block: the lists fill early, and each further block is as large as all before.
HELD, BLOCK = 1_024, 64
#: Partial scores of questions and chunks that a task adds up at once, and pairs of them that it holds.
PARTS, PAIRS = 2_000_000, 2_000_000
#: Terms of questions that a search makes an index of its own for; with more, it keeps all terms of the chunks.
TERMS = 200_000
#: Scores are compared to so many digits, so that the order of sums doesn't show.
DIGITS = 9


class Asked:
    """Questions as terms with weights: ``times * idf`` of each, and the group of chunks that each may find (None: any). ``parts``: the questions of each group, which ``numbers`` tell."""

    def __init__(self, questions: list[list[str]], groups: list, idf: dict[str, float]) -> None:
        self.place = {t: i for i, t in enumerate(sorted({t for q in questions for t in q if t in idf}))}
        self.terms, self.weights, self.numbers = [], [], np.arange(len(questions))
        for q in questions:
            ids, times = np.unique(np.array([self.place[t] for t in q if t in self.place], np.int64), return_counts=True)
            self.terms.append(ids)
            self.weights.append(times * np.array([idf[t] for t in sorted(set(q)) if t in self.place]))
        # pairs of a term and a question that has it, by term
        question = np.repeat(np.arange(len(questions)), [len(ids) for ids in self.terms])
        term, weight = (np.concatenate([np.zeros(0, kind), *own]).astype(kind) for own, kind in ((self.terms, np.int64), (self.weights, np.float64)))
        by = np.argsort(term, kind="stable")
        self.term, self.question, self.weight = term[by], question[by], weight[by]
        kinds: dict[object, list[int]] = {}
        for i, g in enumerate(groups):
            kinds.setdefault(g, []).append(i)
        self.parts = {g: self._some(np.array(own)) for g, own in kinds.items()}

    def _some(self, own: np.ndarray) -> Asked:
        some = copy(self)
        some.terms, some.weights, some.numbers = [self.terms[i] for i in own], [self.weights[i] for i in own], own
        place = np.full(len(self.terms), -1)
        place[own] = np.arange(len(own))
        kept = place[self.question] >= 0
        some.term, some.question, some.weight = self.term[kept], place[self.question[kept]], self.weight[kept]
        return some


class Best:
    """Of each question the best ``k``: score descending, compared to nine digits, then the chunk's place."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.rows, self.scored = k, [[] for _ in range(n)], 0
        self.seen: dict[object, int] = {}  # chunks of each group
        self.bar = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, order: np.ndarray, names: Callable[[int], object]) -> None:
        shown = np.round(score, DIGITS)
        few = np.flatnonzero(shown >= self.bar[q])
        if not len(few):
            return
        if len(few) > self.k:
            few = few[shown[few] >= np.partition(shown[few], -self.k)[-self.k]]
        few = few[np.lexsort((order[few], -shown[few]))][: self.k]
        both = [*self.rows[q], *((float(score[i]), int(order[i]), names(i)) for i in few.tolist())]
        keys = -np.round([r[0] for r in both], DIGITS)
        first = np.lexsort(([r[1] for r in both], keys))[: self.k]
        self.rows[q] = [both[i] for i in first]
        if len(first) == self.k:
            self.bar[q] = -float(keys[first[-1]])


def _places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def scan(asked: Asked, best: Best, names: list, order: np.ndarray, groups: list, dl: np.ndarray, words: list[list[str]], avgdl: float, k1: float, b: float) -> None:
    """Scores what may be among the best of some chunks: their names, places, groups, lengths and tokens."""
    place = asked.place
    pairs = [i * len(place) + place[w] for i, ws in enumerate(words) for w in ws if w in place]
    code, tf = np.unique(np.array(pairs, np.int64), return_counts=True)
    chunk, term = np.divmod(code, max(1, len(place)))
    scan_postings(asked, best, names, order, groups, dl, chunk, term, tf, avgdl, k1, b)


def scan_postings(asked: Asked, best: Best, names: list, order: np.ndarray, groups: list, dl: np.ndarray, chunk: np.ndarray, term: np.ndarray, tf: np.ndarray, avgdl: float, k1: float, b: float) -> None:
    """The same from the chunks' postings, by chunk: its number, the term's place, and how often the term is in it. Questions about a group meet its chunks alone."""
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[chunk] / avgdl))
    if None in asked.parts:
        _scan(asked.parts[None], best, None, names, order, chunk, term, part)
    held: dict[object, list[int]] = {}
    for i, g in enumerate(groups):
        if g is not None and g in asked.parts:
            held.setdefault(g, []).append(i)
    for g, own in held.items():
        place = np.full(len(names), -1)
        place[own] = np.arange(len(own))
        kept = place[chunk] >= 0
        _scan(asked.parts[g], best, g, [names[i] for i in own], order[own], place[chunk[kept]], term[kept], part[kept])


def _scan(asked: Asked, best: Best, group: object, names: list, order: np.ndarray, chunk: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
    """Chunks that all these questions may find, block by block."""
    n, seen = len(names), best.seen.get(group, 0)
    first = np.searchsorted(chunk, np.arange(n + 1))
    load = np.concatenate(([0], np.cumsum(np.bincount(asked.term, minlength=len(asked.place))[term])))[first]
    lo = 0
    while lo < n and len(chunk):
        most = min(max(BLOCK, seen + lo), max(1, PAIRS // max(1, len(asked.terms))))
        hi = min(n, lo + most, max(lo + 1, int(np.searchsorted(load, load[lo] + PARTS, "right")) - 1))
        own = slice(first[lo], first[hi])
        _block(asked, best, names[lo:hi], order[lo:hi], chunk[own] - lo, term[own], part[own])
        lo = hi
    best.seen[group] = seen + n


def _block(asked: Asked, best: Best, names: list, order: np.ndarray, chunk: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
    """One block of chunks for all questions."""
    n, questions = len(names), len(asked.terms)
    if not len(chunk):
        return
    greatest = np.zeros(len(asked.place))
    np.maximum.at(greatest, term, part)
    # a negative weight adds nothing to a bound
    bound = np.maximum(asked.weight, 0) * greatest[asked.term]
    near = best.bar[asked.numbers] - 10.0**-DIGITS
    # of each question the terms of least bounds that don't reach its list together
    by = np.lexsort((bound, asked.question))
    total = np.cumsum(bound[by])
    starts = np.searchsorted(asked.question[by], np.arange(questions))
    before = np.concatenate(([0.0], total))[starts]
    idle = np.zeros(len(by), bool)
    idle[by] = total - before[asked.question[by]] < near[asked.question[by]] - 1e-6  # sums over all questions: less exact
    rest = np.bincount(asked.question[idle], bound[idle], questions)

    def summed(pairs: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """The partial scores of some pairs of terms and questions, by question and chunk, and where there are any."""
        ends = np.searchsorted(asked.term[pairs], np.arange(len(asked.place) + 1))
        t, c = term[at], chunk[at]
        some = _places(ends[t], ends[t + 1])
        posting = np.repeat(np.arange(len(t)), ends[t + 1] - ends[t])
        pair = pairs[some]
        cell = asked.question[pair] * n + c[posting]
        held = np.zeros(questions * n, bool)
        held[cell] = True
        return np.bincount(cell, asked.weight[pair] * part[at][posting], questions * n).reshape(questions, n), held.reshape(questions, n)

    score, held = summed(np.flatnonzero(~idle), slice(None))
    held &= score >= (near - rest)[:, None]
    asks = held.any(1)
    if not asks.any():
        return
    others = np.flatnonzero(idle & asks[asked.question])
    if len(others):
        score += summed(others, np.flatnonzero(held.any(0)[chunk]))[0]
    best.scored += int(held.sum())
    held &= score >= near[:, None]
    for q in np.flatnonzero(held.any(1)).tolist():
        found = np.flatnonzero(held[q])
        best.add(int(asked.numbers[q]), score[q, found], order[found], lambda i, found=found: names[found[i]])


def best_chunks(queries: DataFrame, chunks: DataFrame, k: int = 20, aims: DataFrame | None = None, statistics: DataFrame | None = None, group: str = "vehicle_model", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, index: bm25.Index | None = None) -> DataFrame:
    """``query_id, chunk_id, chunk_ord, score, rank`` of the ``k`` best chunks that share a term with each question (``query_id, question``); with ``aims`` (``query_id, target_no, target``) of each target's chunks, those whose
    ``group`` it is, or of all for a null target, and ``target_no``. ``chunks``: ``chunk_id, chunk_ord, text`` and the group; ``statistics``: the chunks that are counted, where more than these. ``index``:
    that of the chunks that are counted, searched whole if it has ``chunk_ord`` and ``group`` itself; without it one is made for this search."""
    asks = queries.select("query_id", "question")
    asks = asks.withColumns({"target_no": F.lit(0), "target": F.lit(None).cast("string")}) if aims is None else asks.join(aims.select("query_id", "target_no", "target"), "query_id")
    asks = written(asks.withColumn("words", tokens(F.col("question"))).drop("question"), "asked-of-words")
    facts = [F.col("chunk_ord").cast("long").alias("chunk_ord"), F.col(group).cast("string").alias("group")]
    said = asks.select(F.explode("words").alias("term")).distinct()
    n_said, wanted = said.count(), None
    if index is None:
        # an index for this search alone: of all chunks, with the postings of the terms asked for
        wanted = sorted(r.term for r in said.collect()) if n_said <= TERMS else None
        whole = statistics is None or statistics is chunks
        index = bm25.index_of(chunks if whole else statistics, others=tuple(facts) if whole else (), wanted=wanted)
    rows = index.rows if "group" in index.rows.columns else index.rows.join(chunks.select("chunk_id", *facts), "chunk_id")
    rows = rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), "chunk_ord", "group", F.col("dl").cast("double").alias("dl"), "terms", "tfs")
    avgdl = index.totals.first().avgdl
    known = index.weights_of(said, epsilon, n_said <= bm25.BROADCAST_TERMS)
    passes = max(1, -(-asks.count() // QUESTIONS))
    if passes > 1 and "group" not in index.rows.columns:
        rows = written(rows, "rows-searched")
    out: DataFrame | None = None
    for p in range(passes):
        own = asks.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else asks
        some = own.collect()
        terms = known if passes == 1 else known.join(own.select(F.explode("words").alias("term")).distinct(), "term")
        asked = Asked([r.words or [] for r in some], [r.target for r in some], {r.term: r.idf for r in terms.collect()})  # of one pass's questions

        def run(batches: Iterator[pa.RecordBatch], asked: Asked = asked) -> Iterator[pa.RecordBatch]:
            best = Best(len(asked.terms), k)
            place = pa.array(sorted(asked.place, key=asked.place.get), pa.string())
            # an index of its own has the terms' numbers
            numbers = None if wanted is None else np.array([asked.place.get(t, -1) for t in wanted], np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, HELD):
                    names, order, groups, dl, terms, tfs = batch.slice(lo, HELD).columns
                    if numbers is None:
                        term = pc.fill_null(pc.index_in(terms.flatten(), value_set=place), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                        size, tf = pc.list_value_length(terms).to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
                    else:
                        (coded, size), (tf, _) = bm25.unpacked(terms), bm25.unpacked(tfs)
                        term = numbers[coded]
                    chunk, ok = np.repeat(np.arange(len(names)), size), term >= 0
                    scan_postings(asked, best, names.to_pylist(), order.to_numpy(zero_copy_only=False), groups.to_pylist(), dl.to_numpy(zero_copy_only=False), chunk[ok], term[ok], tf[ok], avgdl, k1, b)
            found = [(q, name, order, score) for q, rows in enumerate(best.rows) for score, order, name in rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["no", "chunk_id", "chunk_ord", "score"])

        ids = queries.sparkSession.createDataFrame([(i, r.query_id, r.target_no) for i, r in enumerate(some)], f"no long, query_id {asks.schema['query_id'].dataType.simpleString()}, target_no int")
        part = rows.mapInArrow(run, "no long, chunk_id string, chunk_ord long, score double").join(F.broadcast(ids), "no").drop("no")  # of one pass's questions
        out = part if out is None else out.unionByName(part)
    by = ["query_id"] if aims is None else ["query_id", "target_no"]
    ranked = Window.partitionBy(*by).orderBy(F.round("score", DIGITS).desc(), "chunk_ord")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(*by, "chunk_id", "chunk_ord", "score", F.col("rank").cast("int"))
