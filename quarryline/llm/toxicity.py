"""Toxicity by a weighted lexicon.

Texts are folded: lower case, accents and invisible signs dropped, look-alike letters of other scripts or styles and digits or signs that stand for
letters become the letters, the rest becomes white space. An Aho-Corasick automaton finds the lexicon's words and word beginnings at word starts; matches
inside an exception phrase don't count. The weights found, over the text's number of words, give the score through a logistic curve.

The lexicon is learned: words and word beginnings of labelled texts whose rate in toxic ones exceeds that in others by far; the
weight is the log ratio of the rates.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarryline.llm.common import documents, held_out, text_of, written

#: At most about so many labelled rows are learned from, chosen by a hash of their id.
LABELLED = 20_000
#: Beginnings of so many letters are candidates, beside whole words.
BEGINNINGS = range(4, 9)
#: The least log ratio of an entry's rates in toxic texts and others, and by how many standard deviations the toxic texts that hold it exceed what's expected.
RATIO, STRENGTH = 0.8, 5
#: Look-alike letters, and digits and signs that stand for letters.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһкмтвнɡɑοαρτυνικ", "aeopcyxijsdhkmtbhgaoaptuvik", strict=True))
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon's word means no harm.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car", "pond scum", "trash collection")
#: Code points from here on are no letters; from the second on, to the third, they are invisible tags.
_LETTERS, _TAGS, _TAGS_END = 0x33480, 0xE0000, 0xE0200


@lru_cache(1)
def _folds() -> np.ndarray:
    """What each code point becomes: a letter, a space, or nothing (0: marks and format signs)."""
    table = np.full(_LETTERS + 1, 32, np.uint32)
    for i in range(_LETTERS):
        if 0xD800 <= i < 0xE000:
            continue
        if unicodedata.category(chr(i)) in ("Cf", "Mn", "Me"):
            table[i] = 0
            continue
        x = unicodedata.normalize("NFKC", chr(i)).lower()
        bare = [c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)]
        x = bare[0] if len(bare) == 1 else x
        x = LOOK_ALIKES.get(x, STANDS_FOR.get(x, x))
        if len(x) == 1 and x.isalpha():
            table[i] = ord(x)
    return table


def fold(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts folded, each with a space before and after; where each begins (one more than texts); their numbers of words. A sign that
    ends a word ("idiot!") stays a space."""
    code = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 2 for t in texts]))).astype(np.int64)
    out = _folds()[np.minimum(code, _LETTERS)]
    seen = (out != 0) & ((code < _TAGS) | (code >= _TAGS_END))
    if not seen.all():
        code, out, offsets = code[seen], out[seen], np.concatenate(([0], np.cumsum(seen)))[offsets]
    signs = np.flatnonzero((code == 33) | (code == 64) | (code == 36))
    signs = signs[(out[signs + 1] == 32) | (out[signs - 1] == 32) & (code[signs] == 33)]
    out[signs] = 32
    begins = np.flatnonzero((out[1:] != 32) & (out[:-1] == 32))
    words = np.diff(np.searchsorted(begins, offsets))
    return out.tobytes().decode("utf-32-le", "surrogatepass"), offsets, words


@lru_cache(4)
def _automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):  # noqa: ANN202
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in lexicon:
        found.add_word(" " + (entry[:-1] if entry.endswith("*") else entry + " "), (len(entry) + 1, weight))
    for phrase in exceptions:
        found.add_word(f" {phrase} ", (len(phrase) + 2, None))
    found.make_automaton()
    return found


def measure(texts: list[str], lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[np.ndarray, np.ndarray]:
    """The summed weight of each text's matches outside exceptions, and its number of words."""
    text, offsets, words = fold(texts)
    total = np.zeros(len(texts))
    if lexicon and texts:
        hits = list(_automaton(lexicon, exceptions).iter(text))
        spans = [(end + 1 - n, end + 1) for end, (n, w) in hits if w is None]
        inside = np.zeros(len(text) + 1, bool) if spans else None
        for a, b in spans:
            inside[a:b] = True
        ends = np.array([end for end, (_, w) in hits if w is not None], np.int64)
        weights = np.array([w for _, (_, w) in hits if w is not None])
        if inside is not None and len(ends):
            ends, weights = ends[~inside[ends - 1]], weights[~inside[ends - 1]]
        np.add.at(total, np.searchsorted(offsets, ends, "right") - 1, weights)
    return total, words


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A constant, the weight over the words, the weight and the words on a log scale."""
    return np.stack([np.ones(len(total)), 10 * total / (words + 10), np.log1p(total), np.log1p(words) / 5], 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _entries(word: str) -> list[str]:
    """A word as candidates: itself, and its beginnings with a star."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each candidate occurs in texts of either label, and in how many texts; all words and texts under the empty name."""
    total: tuple[Counter, ...] = (Counter(), Counter())
    within: tuple[Counter, ...] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = Counter(fold([text])[0].split())
            total[label].update(words)
            within[label].update({e for w in words for e in _entries(w)})
            within[label][""] += 1
    parts: tuple[Counter, ...] = (Counter(), Counter())
    for label in (0, 1):
        for w, n in total[label].items():
            parts[label][""] += n
            for e in _entries(w):
                parts[label][e] += n
    names = sorted(within[0].keys() | within[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([p[w] for w in names], pa.int64()) for p in (*parts, *within)]], ["entry", "clean", "toxic", "clean_texts", "toxic_texts"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED) -> tuple:
    """The lexicon and the curve's coefficients, from labelled rows: about ``most`` of them, by a hash of their id. Null labels are left out. All entries strong
    enough are in the lexicon; as each occurs in the labelled rows, these bound it."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = marked.count()
    draw = F.crc32(F.concat(F.lit("toxic:"), F.col("label_id").cast("string"))) / float(2**32)
    chosen = written(marked.where(draw < min(1.0, most / max(1, n))), "labels")
    # about ``most`` rows of two numbers: the bound of what is broadcast
    rows = written(docs.select(F.col(id_col).alias("label_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "label_id").select("text", "label"), "labelled")
    kinds = ("clean", "toxic", "clean_texts", "toxic_texts")
    counted = rows.mapInArrow(_counts, "entry string, " + ", ".join(f"{c} long" for c in kinds)).groupBy("entry").agg(*[F.sum(c).alias(c) for c in kinds])
    counts = written(counted.where("entry = '' OR toxic_texts > 0"), "entries")
    total = counts.where("entry = ''").first()
    if not total or not total.toxic or not total.clean:
        return ((), (-3.0, 0.0, 0.0, 0.0))
    ratio = F.log((F.col("toxic") + 0.5) / (total.toxic + 1)) - F.log((F.col("clean") + 0.5) / (total.clean + 1))
    # by texts, so that a word that one text repeats doesn't count for more than one
    expected = (F.col("toxic_texts") + F.col("clean_texts")) * (total.toxic_texts / (total.toxic_texts + total.clean_texts))
    strong = (F.col("toxic_texts") - expected) / F.sqrt(expected + 1)
    best = counts.where("entry <> ''").select("entry", ratio.alias("ratio"), strong.alias("strong")).where(f"ratio >= {RATIO} AND strong >= {STRENGTH}").orderBy(F.desc("strong"), F.desc(F.length("entry")), "entry").collect()
    chosen_entries: dict[str, float] = {}
    stems: set[str] = set()
    starts: set[str] = set()  # of the stems
    for r in best:
        stem = r.entry.rstrip("*")
        own = {stem[:k] for k in range(1, len(stem) + 1)}
        if stem not in starts and not own & stems:
            chosen_entries[r.entry] = round(r.ratio, 6)
            stems.add(stem)
            starts |= own
    lexicon = tuple(sorted(chosen_entries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, w = measure(batch.column(0).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.float64()), pa.array(w, pa.int64()), batch.column(1)], ["total", "words", "label"])

    # three numbers for each of the labelled rows
    seen = np.array(sorted(tuple(r) for r in rows.mapInArrow(run, "total double, words long, label int").collect()), float)
    return (lexicon, tuple(float(x) for x in fit(features(seen[:, 0], seen[:, 1]), seen[:, 2])))


def score(text: Column, model: tuple) -> Column:
    """The score of a text, 0 to 1; null counts as empty."""
    lexicon, weights = model

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(texts), 512):
            t, w = measure([x or "" for x in texts.slice(lo, 512).to_pylist()], lexicon)
            out.append(1 / (1 + np.exp(-np.clip(features(t, w) @ np.array(weights), -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return scored(text)


def rate(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, score, predicted``. Null text counts as empty; repeated rows are scored each; an empty table gives no rows; other columns are not
    read."""
    return docs.select(F.col(id_col).alias("doc_id"), score(text_of(text_col), model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_harmless(docs: DataFrame, model: tuple) -> DataFrame:
    """``docs`` without those that are predicted toxic, all columns as they were, whatever their names. Null text counts as empty and stays, as an empty text is
    never predicted toxic unless most labelled ones are; repeated rows stay or go together; an empty table gives no rows."""
    return docs.where(score(text_of(), model) < 0.5)


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, read_labels(spark, sf_dir).where(~held_out()))
    return rate(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_toxicity": op6_toxicity}
#: Learning and Aho-Corasick can't be expressed in SQL; the query is tested against a plain matcher and by held-out accuracy.
SQL: dict[str, str] = {}
