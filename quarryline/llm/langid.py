"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed by each automaton: from where the last
phrase ended, the longest match in the language's text is the next phrase. Phrases times the logarithm of the language's text length, over the
text's length, estimate the cross entropy; the language of least entropy wins.

Letters are written in a code of 64 symbols, the commonest letters of all samples in one, others in two to four, so that scripts of any size are
kept whole. All positions of a batch are parsed in step: texts are cut into segments of ``SEGMENT`` symbols (a phrase ends there as well), and one
table lookup moves every segment of every language one symbol on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import documents, held_out, text_of

#: Letters of labelled text for each language: the bound of what is learned from.
LETTERS = 24_000
SEGMENT = 256
#: First symbols of letters of one, two, three and four symbols: 48 + 640 + 16,384 + 524,288 letters, more than there are.
_LEADS = (48, 10, 4, 2)
_CODES = 0x3100


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below ``_CODES``: itself in lower case; whether it is a letter."""
    lower = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(_CODES)], np.uint32)
    return lower, np.array([chr(i).isalpha() for i in range(_CODES)])


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points, each run of others than letters as one 0; where each text begins (one more than texts)."""
    lower, alpha = _kinds()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    low = np.minimum(code, _CODES - 1)
    out = np.where(alpha[low] & (code < _CODES), lower[low], 0)
    for c in np.unique(code[code >= _CODES]):
        if chr(c).isalpha():
            out[code == c] = c
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def in_symbols(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters, by how common they are, as symbols 1 to 64; and of how many each is. -1, a letter of no sample, is the symbol 0."""
    size, value = np.ones(len(rank), np.int64), rank.astype(np.int64)
    letters_before = lead = _LEADS[0]
    for n, leads in enumerate(_LEADS[1:], 2):
        at = rank >= letters_before
        size[at], value[at] = n, (lead << 6 * (n - 1)) + rank[at] - letters_before
        letters_before, lead = letters_before + (leads << 6 * (n - 1)), lead + leads
    ends = np.cumsum(size)
    out = np.zeros(size.sum(), np.uint8)
    for n in range(1, len(_LEADS) + 1):
        at = np.flatnonzero((size == n) & (rank >= 0))
        for k in range(n):
            out[ends[at] - n + k] = ((value[at] >> 6 * (n - 1 - k)) & 63) + 1
    return out, size


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions of the automaton of all substrings: state x symbol, -1 where there is none; state 0 is the start."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.full((len(step), width), -1, np.int32)
    for i, moves in enumerate(step):
        for c, j in moves.items():
            table[i, c] = j
    return table


class CrossParser:
    """``samples``: (language, labelled text) pairs."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.langs = [k for k, _ in samples]
        texts = [letters([t])[0] for _, t in samples]
        self.known, counts = np.unique(np.concatenate(texts), return_counts=True)
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        # symbol 0 is what no sample has; after the code's comes one that keeps the state
        self.stay = min(sum(_LEADS), len(self.known)) + 1
        self.width = self.stay + 1
        tables, roots, base = [], [], 0
        coded = [self.symbols(t)[0] for t in texts]
        for own in coded:
            moves = suffix_automaton([int(x) for x in own], self.width)
            moves[:, 0] = -1
            root = np.where(moves[0] >= 0, moves[0], 0)
            missed = moves < 0
            moves = (np.where(missed, root[None, :], moves) + base) * self.width
            moves[missed] |= 1 << 30
            moves[:, self.stay] = (np.arange(len(moves)) + base) * self.width
            tables.append(moves)
            roots.append(base * self.width)
            base += len(moves)
        self.moves, self.roots = np.concatenate(tables).ravel().astype(np.int32), np.array(roots, np.int32)
        self.bits = np.log2([max(2, len(t)) for t in coded])

    def symbols(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return in_symbols(np.where(self.known[at] == codes, self.rank[at], -1))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (language x text), lengths in symbols, and whether a text has a letter."""
        codes, offsets = letters(texts)
        has = np.add.reduceat(np.append(codes != 0, False), offsets[:-1]).astype(bool) & (np.diff(offsets) > 0) if len(texts) else np.zeros(0, bool)
        symbols, each = self.symbols(codes)
        offsets = np.concatenate(([0], np.cumsum(each)))[offsets]
        size = np.diff(offsets)
        pieces = -(-size // SEGMENT)
        ends = np.cumsum(pieces)
        board = np.full((int(pieces.sum()), SEGMENT), self.stay, np.uint8)
        within = np.arange(len(symbols)) - np.repeat(offsets[:-1], size)
        board.ravel()[np.repeat((ends - pieces) * SEGMENT, size) + within] = symbols
        columns = np.ascontiguousarray(board.T)
        state = np.repeat(self.roots[:, None], len(board), 1)
        count = np.zeros(state.shape, np.int32)
        for column in columns:
            state = self.moves[state + column]
            count += state >> 30
            state &= (1 << 30) - 1
        total = np.concatenate((np.zeros((len(self.langs), 1), np.int64), np.cumsum(count + 1, 1)), 1)
        return total[:, ends] - total[:, ends - pieces], size, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages, and scores: how far the second least entropy lies above the least, over itself."""
        phrases, size, has = self.phrases(texts)
        entropy = phrases * self.bits[:, None] / np.maximum(size, 1)
        order = np.argsort(entropy, 0, kind="stable")
        least = np.take_along_axis(entropy, order[:1], 0)[0]
        second = np.take_along_axis(entropy, order[1:2], 0)[0] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = np.where(has, 1 - least / np.maximum(second, 1e-12), 0.0)
        return [self.langs[i] if h else "und" for i, h in zip(order[0], has, strict=True)], np.clip(score, 0, 1)


@lru_cache(2)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(samples)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = LETTERS) -> tuple[tuple[str, str], ...]:
    """For each language, whole texts in the order of a hash of their id until they have ``size`` characters, cut there. What is
    collected is some three times that for each language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_of(text_col)) > 0)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    if not sums:
        return ()
    share = F.create_map(*[F.lit(x) for r in sums for x in (r.lang, float(min(1.0, max(3 * size / r.chars, 30 / r.n))))])
    draw = F.crc32(F.concat(F.lit("lang:"), F.coalesce("id", F.lit("")))) / float(2**32)
    taken: dict[str, str] = {}
    for r in sorted(rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")]).select("lang", "draw", "id", F.substring("text", 1, 4 * size).alias("text")).collect(), key=lambda r: (r.lang, r.draw, r.id or "", r.text)):
        if len(taken.get(r.lang, "")) < size:
            taken[r.lang] = (taken.get(r.lang, "") + " " + r.text)[: size + 1]
    return tuple(sorted(taken.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, lang_pred, score``.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. Ties go to the first language by name. Repeated rows are judged each; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                langs, score = _parser(samples).predict(some.column(1).to_pylist()) if samples else (["und"] * some.num_rows, np.zeros(some.num_rows))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_language_id": op2_language_id}
#: Suffix automata can't be expressed in SQL; the query is tested against a plain parse and by held-out accuracy.
SQL: dict[str, str] = {}
