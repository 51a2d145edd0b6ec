"""Contents entries that fit the words of questions.

An entry scores one for each word in its path or title and two for each part of its path that a word lies in or that lies in a word. No word is tried on every part of every entry: the
questions' words are one automaton, which finds all words in a part in one pass, and a table of their pieces tells the words that a part lies in. What a part holds is found once a task
for each distinct part; an entry's scores for all questions about its model are then sums over the words found. Only the best entries of each question leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.sources.scratch import written

#: Rows of questions that travel to all tasks at once; a larger set is matched in blocks of about so many.
QUESTIONS = 2_000
#: Pieces of words up to this length are in the table; longer parts are looked for in longer words alone.
PIECE = 24
#: Bytes of parts and their words that a task remembers, about; and entries that it scores at once.
REMEMBERED, ROWS = 16_000_000, 1_000


class Words:
    """All words of some questions, and which of them a part of a path holds or lies in."""

    def __init__(self, words: list[str]) -> None:
        import ahocorasick

        self.words = words
        self.inside = ahocorasick.Automaton()
        self.pieces: dict[str, list[int]] = {}
        self.long: list[tuple[int, str]] = []
        for i, w in enumerate(words):
            self.inside.add_word(w, i)
            for piece in {w[a : a + n] for n in range(1, min(len(w), PIECE) + 1) for a in range(len(w) - n + 1)}:
                self.pieces.setdefault(piece, []).append(i)
            if len(w) > PIECE:
                self.long.append((i, w))
        if words:
            self.inside.make_automaton()
        #: Words that may lie across two parts.
        self.across = [(i, w) for i, w in enumerate(words) if ">" in w]
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def of(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        """Words in the part; and these with the words that the part lies in."""
        found = self.known.get(part)
        if found is None:
            inside = {i for _, i in self.inside.iter(part)} if self.words else set()
            around = self.pieces.get(part, ()) if len(part) <= PIECE else [i for i, w in self.long if part in w]
            held = np.fromiter(inside, np.int32, len(inside))
            more = [i for i in around if i not in inside]
            found = held, np.concatenate([held, np.array(more, np.int32)]) if more else held
            own = 2 * len(part) + 8 * len(found[1]) + 300
            if self.size + own > REMEMBERED:
                self.known.clear()
                self.size = 0
            if own <= REMEMBERED:
                self.known[part] = found
                self.size += own
        return found

    def count(self, row: np.ndarray, path: str, title: str) -> None:
        """Sets ``row`` (of zeros, by words) to how much an entry scores for each word."""
        path, title = path.lower(), title.lower()
        parts = [p for p in path.split(">") if p]
        for part in {*parts, *(p for p in title.split(">") if p)}:
            row[self.of(part)[0]] = 1
        if self.across:
            hay = f"{path}>{title}"
            row[[i for i, w in self.across if w in hay]] = 1
        for part in parts:
            row[self.of(part)[1]] += 2


def _key(value: object) -> object:
    return tuple(_key(v) for v in value.values()) if isinstance(value, dict) else value


class _Lists:
    """Of each key the first ``most`` entries by an order, as (order, score, row of the batch's columns)."""

    def __init__(self, most: int) -> None:
        self.most, self.best = most, {}

    def add(self, key: object, rows: list[tuple]) -> None:
        self.best[key] = sorted([*self.best.get(key, []), *rows], key=lambda r: r[0])[: self.most]


def _matched(asked: list, models: list[str], entries: DataFrame, most: int, general: list[str] | None, catalogue: bool) -> DataFrame:
    """The candidates of each task, without their texts: ``no, kind, score, entry`` and what entries are ordered by. Kind 1 are the best of a question, ``no`` its number; of a catalogue kind 2 are the deepest and kind 3 the
    first entries of a model whatever the question, ``no`` the model's number."""
    words = sorted({w for r in asked for w in r.words or ()})
    place = {w: i for i, w in enumerate(words)}
    by_model: dict[str, list[int]] = {m: [] for m in models}
    for i, r in enumerate(asked):
        if r.vehicle_model is not None:
            by_model[r.vehicle_model].append(i)
    lists_of = [[place[w] for w in r.words or ()] for r in asked]
    names = general or []
    unnamed = np.array([[0.0 if g in (r.question or "") else 3.0 for g in names] for r in asked]).reshape(len(asked), len(names))
    small = ["entry", "ord", *(["level", "page"] if catalogue else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(words)
        weights: dict[str, np.ndarray] = {}  # words by questions of a model
        for model, qs in by_model.items():
            weights[model] = np.zeros((len(words), len(qs)), np.float32)
            for k, q in enumerate(qs):
                np.add.at(weights[model][:, k], lists_of[q], 1)
        lists, types = {kind: _Lists(most) for kind in (1, 2, 3)}, {}
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            types = {c: batch.column(c).type for c in small}
            held = {c: batch.column(c).to_pylist() for c in ("vehicle_model", "path", "title", *small)}
            own = list(zip(*(held[c] for c in small), strict=True))
            keys = [_key(o) for o in held["ord"]]
            paths = [x or "" for x in held["path"]]
            groups: dict[str, list[int]] = {}
            for i, m in enumerate(held["vehicle_model"]):
                if m in by_model:
                    groups.setdefault(m, []).append(i)
            for model, members in groups.items():
                qs = by_model[model]
                if catalogue:
                    lists[2].add(models.index(model), [((-held["level"][i], held["page"][i], keys[i]), 0.0, own[i]) for i in members])
                    lists[3].add(models.index(model), [((keys[i],), 0.0, own[i]) for i in members])
                counts = np.zeros((len(members), len(words)), np.float32)
                for k, i in enumerate(members):
                    known.count(counts[k], paths[i], held["title"][i] or "")
                match = (counts @ weights[model]).astype(float)  # whole numbers
                size = np.array([len(paths[i]) for i in members]) * 0.01
                has = np.array([[g in paths[i] for g in names] for i in members], float).reshape(len(members), len(names))
                score = np.round(match + size[:, None] - has @ unnamed[qs].T, 6)
                for k, q in enumerate(qs):
                    if not lists_of[q]:
                        continue
                    ok = np.flatnonzero((match if catalogue else score)[:, k] > 0)
                    if len(ok) > most:
                        ok = ok[score[ok, k] >= np.partition(score[ok, k], -most)[-most]]
                    lists[1].add(q, [((-score[j, k], keys[members[j]]), float(score[j, k]), own[members[j]]) for j in ok.tolist()])
        out = [(no, kind, s, *r) for kind, found in lists.items() for no, rows in found.best.items() for _, s, r in rows]
        if out:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.float64(), *types.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["no", "kind", "score", *small])

    of = dict(entries.dtypes)
    return entries.select("vehicle_model", "path", "title", *small).mapInArrow(run, "no long, kind int, score double, " + ", ".join(f"`{c}` {of[c]}" for c in small))


def _in_blocks(asked: DataFrame, entries: DataFrame, most: int, general: list[str] | None, catalogue: bool) -> DataFrame:
    """The ``most`` entries of each row of ``asked`` with ``score`` and ``position``. Texts stay where they are until the lists are cut: tasks give numbers of entries, which meet the entries at the end."""
    spark = entries.sparkSession
    asked = written(asked, "asked-of-contents")
    blocks = max(1, -(-asked.count() // QUESTIONS))
    # matching an entry costs more than moving it; numbers hold once they are written
    dealt = written(entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("entry", F.monotonically_increasing_id()), "entries-numbered")
    keep = [c for c in asked.columns if c not in entries.columns]
    out: DataFrame | None = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() if blocks > 1 else asked.collect()
        models = sorted({r.vehicle_model for r in some} - {None})
        found = written(_matched(some, models, dealt, most, general, catalogue), "candidates")
        numbers = spark.createDataFrame([(i, *[r[c] for c in keep], models.index(r.vehicle_model) if r.vehicle_model in models else None, 2 if r.words else 3) for i, r in enumerate(some)], "no long, " + "".join(f"`{c}` {k}, " for c, k in asked.dtypes if c in keep) + "_model long, _kind int")
        best = found.where("kind = 1").drop("kind")
        own = Window.partitionBy("no").orderBy(F.col("score").desc(), "ord")
        cut = best.withColumn("position", F.row_number().over(own)).where(F.col("position") <= most).select("no", "entry", "score", "position")
        if catalogue:
            order = [F.when(F.col("kind") == 2, -F.col("level").cast("double")), F.when(F.col("kind") == 2, F.col("page")), "ord"]
            plain = found.where("kind > 1").withColumn("position", F.row_number().over(Window.partitionBy("no", "kind").orderBy(*order))).where(F.col("position") <= most)
            unmet = numbers.select("no", "_model", "_kind").join(best.select("no").distinct(), "no", "left_anti")
            cut = cut.unionByName(unmet.join(plain.select(F.col("no").alias("_model"), F.col("kind").alias("_kind"), "entry", "score", "position"), ["_model", "_kind"]).select("no", "entry", "score", "position"))
        part = cut.join(F.broadcast(numbers.drop("_model", "_kind")), "no").drop("no")  # the block's questions
        out = part if out is None else out.unionByName(part)
    return out.join(dealt, "entry").drop("entry")


def matched_entries(asked: DataFrame, entries: DataFrame, most: int = 3, general: list[str] | None = None) -> DataFrame:
    """The ``most`` best entries of a question's model for each row of ``asked`` (``query_id, vehicle_model, words, question`` and others), with ``score`` and ``position``: columns of both sides. General
    sections that the question doesn't name count three less. As the path's length always counts, long paths come in where no word matches; none come for a question without words. ``entries``: ``vehicle_model, path, title, ord`` and
    others; ``ord`` decides among equal scores. Null models meet nothing."""
    return _in_blocks(asked, entries, most, general, False)


def catalogue(asked: DataFrame, entries: DataFrame, most: int = 80) -> DataFrame:
    """The ``most`` entries of a question's model that a completion chooses from, with ``position``: by score where any entry matches, else the deepest first, then by page; in order for a question without
    words. Columns as for ``matched_entries``; ``entries`` with ``level`` and ``page`` too."""
    return _in_blocks(asked, entries, most, None, True).drop("score")
