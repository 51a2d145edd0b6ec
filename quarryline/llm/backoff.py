"""Scores of a bigram language model by weighted backoff automata.

The model is interpolated: ``p(w|v) = (1 - u) c(vw) / (c(v) + K) + l(v) p(w)``, ``l(v) = (u c(v) + K) / (c(v) + K)``, ``p(w) = (c(w) + 1) / (N + V + 1)``, where ``u`` is
the share of training bigrams seen once (what is unseen, by Good and Turing) and a word never seen has ``c = 0``; after such a word, and at a text's beginning, ``p(w)`` holds. Of
all counts none is cut off, so they grow with the corpus and no task holds them all:

1. One pass cuts the documents into blocks of some megabytes, a row each: the block's words as hashes, and its texts as numbers of these words.
2. Each block asks for the words and bigrams that it holds: their sorted keys, cut by the buckets of all keys, with its own training counts. A bucket adds the
   counts of all blocks and answers each with totals alone, in the order that it asked in.
3. A block and its answers meet. They give the part of the automaton that the block's texts can reach: a state for each known word and one for none, an arc for
   each bigram seen, and a failure arc to the state for none with the weight ``l(v)``. Texts are walked through it from left to right, all
   pieces of the block's texts in step, carrying the state and adding up log probabilities.

A word of any frequency is asked for once a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.buffers import as_bytes, batches_of, hash_spans, mix64, tokens
from quarryline.llm.common import documents, text_of, written

#: Bytes of text of a block, about; a longer text is a block of its own. Keys of a bucket, about.
BLOCK, BUCKET = 16 << 20, 2_000_000
#: How many counts the backing off of a context weighs besides its unseen share.
PRIOR = 2.0
#: Tokens that are walked one after another; longer texts are cut and each piece begins in the state that the word before it leads to.
STEP = 1024
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_U = np.uint64
#: The end's key: no word holds a space.
_END = hash_spans(np.frombuffer(b" end", np.uint8), np.array([0]), np.array([4]))
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 by 7; such documents teach nothing. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(True))


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on: all first bytes, all second bytes and so on, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(raw[9:], n * width, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ``BLOCK`` bytes of text."""
    held, size = [], 0
    for some in batches_of(batches, most=BLOCK):
        n = len(as_bytes(some.column(1))[0])
        if held and size + n > BLOCK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held, size = [*held, some], size + n
    if held:
        yield pa.Table.from_batches(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nth, rows in enumerate(_filled(batches)):
        data, starts, ends, first = tokens(rows.column(1).combine_chunks(), _WORD)
        h = hash_spans(data, starts, ends)
        order = np.argsort(h)
        new = np.concatenate((np.ones(min(1, len(h)), bool), h[order][1:] != h[order][:-1]))
        words, count = h[order][new], np.diff(np.concatenate((np.flatnonzero(new), [len(h)])))
        # common words have small numbers
        rank = np.argsort(-count, kind="stable")
        number = np.empty(len(rank), np.int64)
        number[rank] = np.arange(len(rank))
        ids = np.empty(len(h), np.int64)
        ids[order] = number[np.cumsum(new) - 1]
        part = rows.column(3)[0].as_py()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part * 2**31 + nth], pa.int64()),
                pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([rows.column(2).to_pylist()], pa.list_(pa.bool_())),
                pa.array([packed(np.diff(first))], pa.binary()),
                pa.array([words[rank].tobytes()], pa.binary()),
                pa.array([packed(ids)], pa.binary()),
                pa.array([len(h) + rows.num_rows], pa.int64()),
            ],
            ["block", "doc_ids", "held_out", "sizes", "words", "ids", "tokens"],
        )


class Block:
    """A block's texts as tokens (the end is the last number), its words' keys, and its bigrams."""

    def __init__(self, held_out: list[bool], sizes: bytes, words: bytes, ids: bytes) -> None:
        size = unpacked(sizes).astype(np.int64)
        self.keys = np.concatenate((np.frombuffer(words, np.uint64), _END))
        self.first = np.concatenate(([0], np.cumsum(size + 1)))
        self.ids = np.full(self.first[-1], len(self.keys) - 1)
        inner = np.ones(len(self.ids), bool)
        inner[self.first[1:] - 1] = False
        self.ids[inner] = unpacked(ids).astype(np.int64)
        train = np.repeat(~np.array(held_out, bool), size + 1)
        begins = np.zeros(len(self.ids), bool)
        begins[self.first[:-1]] = True
        n = len(self.keys)
        # bigrams as numbers, each once, with those of training texts counted
        pairs = np.sort(((np.concatenate(([0], self.ids[:-1])) * n + self.ids) * 2 + train)[~begins])
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(pairs)), bool), pairs[1:] >> 1 != pairs[:-1] >> 1)))
        self.pairs = pairs[new] >> 1
        own = np.add.reduceat(pairs & 1, new) if len(new) else pairs
        with np.errstate(over="ignore"):
            v, w = np.divmod(self.pairs, n)
            pair_keys = mix64(mix64(self.keys[v] + _U(1)) + self.keys[w])
        #: By kind (1: words, 2: bigrams): keys, training counts, and the order of keys.
        self.asked = {1: (self.keys, np.bincount(self.ids[train], minlength=n)), 2: (pair_keys, own)}
        self.order = {kind: np.argsort(k) for kind, (k, _) in self.asked.items()}


def _requests(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            b = Block(row["held_out"], row["sizes"], row["words"], row["ids"])
            out = []
            for kind, (keys, counts) in b.asked.items():
                keys, counts = keys[b.order[kind]], counts[b.order[kind]]
                bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.zeros(0, np.int64)
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=False):
                    some = keys[lo:hi]
                    out.append((kind, int(bucket[lo]), row["block"], packed(np.concatenate((some[:1], np.diff(some)))), packed(counts[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["kind", "bucket", "block", "keys", "counts"])


def _answers(key: tuple, rows: pa.Table) -> pa.Table:
    """Each block's totals, and a row without a block: the sum, the keys seen and the keys seen once."""
    kind, bucket = key[0].as_py(), key[1].as_py()
    with np.errstate(over="ignore"):
        asked = [np.cumsum(unpacked(k)) for k in rows.column("keys").to_pylist()]
    keys, counts = np.concatenate(asked), np.concatenate([unpacked(c) for c in rows.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys)
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    total = np.empty(len(keys), np.int64)
    total[order] = sums[np.cumsum(new) - 1]
    cut = np.cumsum([0, *map(len, asked)]).tolist()
    n = len(asked)
    return pa.table(
        {
            "block": pa.array([*rows.column("block").to_pylist(), None], pa.int64()),
            "kind": pa.array([kind] * (n + 1), pa.int32()),
            "bucket": pa.array([bucket] * (n + 1), pa.int64()),
            "totals": pa.array([*[packed(total[a:b]) for a, b in zip(cut, cut[1:], strict=False)], None], pa.binary()),
            "counted": pa.array([None] * n + [int(sums.sum())], pa.int64()),
            "seen": pa.array([None] * n + [int((sums > 0).sum())], pa.int64()),
            "once": pa.array([None] * n + [int((sums == 1).sum())], pa.int64()),
        }
    )


class Automaton:
    """States 0 to ``len(fail_to) - 1``; arcs by ``state * words + word``, ascending. State 0 has an arc for every word and never fails."""

    def __init__(self, words: int, arc: np.ndarray, weight: np.ndarray, to: np.ndarray, fail_to: np.ndarray, fail_weight: np.ndarray) -> None:
        self.words, self.arc, self.weight, self.to, self.fail_to, self.fail_weight = words, arc, weight, to, fail_to, fail_weight

    @classmethod
    def of_bigrams(cls, c: np.ndarray, pairs: np.ndarray, c2: np.ndarray, tokens_: int, types: int, unseen: float, prior: float) -> Automaton:
        """From the words' counts and the bigrams' (``v * words + w``, ascending). State ``1 + v`` follows the known word ``v``."""
        n = len(c)
        p1 = (c + 1) / (tokens_ + types + 1)
        state = np.where(c > 0, 1 + np.arange(n), 0)
        pairs, c2 = pairs[c2 > 0], c2[c2 > 0]
        v, w = np.divmod(pairs, n)
        back = (unseen * c + prior) / (c + prior) if n else c.astype(float)
        p2 = (1 - unseen) * c2 / (c[v] + prior) + back[v] * p1[w]
        arc = np.concatenate((np.arange(n), (1 + v) * n + w))
        return cls(n, arc, np.log10(np.concatenate((p1, p2))), np.concatenate((state, state[w])), np.zeros(n + 1, np.int64), np.concatenate(([0.0], np.log10(back))))

    def walk(self, ids: np.ndarray, first: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The weight of each piece of ``ids`` (pieces begin at ``first``, one more than pieces) from its ``state`` on; all pieces go in step."""
        long_first = np.argsort(-np.diff(first), kind="stable")
        at, left = first[:-1][long_first], np.diff(first)[long_first]
        state, total = state[long_first].copy(), np.zeros(len(at))
        for step in range(int(left[0]) if len(left) else 0):
            live = np.arange(int(np.searchsorted(-left, -step, "left")))
            word = ids[at[: len(live)] + step]
            while len(live):
                key = state[live] * self.words + word[live]
                arc = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                hit = self.arc[arc] == key
                total[live[hit]] += self.weight[arc[hit]]
                state[live[hit]] = self.to[arc[hit]]
                live = live[~hit]
                total[live] += self.fail_weight[state[live]]
                state[live] = self.fail_to[state[live]]
        out = np.empty(len(total))
        out[long_first] = total
        return out


def _scores(model: dict, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    row = blocks.select(["doc_ids", "held_out", "sizes", "words", "ids"]).to_pylist()[0]
    b = Block(row["held_out"], row["sizes"], row["words"], row["ids"])
    totals = {}
    for kind in (1, 2):
        mine = sorted((r for r in answers.select(["kind", "bucket", "totals"]).to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
        totals[kind] = np.zeros(len(b.order[kind]), np.int64)
        totals[kind][b.order[kind]] = np.concatenate([np.zeros(0, np.int64), *[unpacked(r["totals"]).astype(np.int64) for r in mine]])
    c = totals[1]
    automaton = Automaton.of_bigrams(c, b.pairs, totals[2], model["tokens"], model["types"], model["unseen"], model["prior"])
    cuts = np.unique(np.concatenate((b.first, *[np.arange(x, y, STEP) for x, y in zip(b.first.tolist(), b.first[1:].tolist(), strict=False) if y - x > STEP])))
    before = b.ids[np.maximum(cuts[:-1] - 1, 0)]
    state = np.where(np.isin(cuts[:-1], b.first) | (c[before] == 0), 0, 1 + before)
    place = np.searchsorted(cuts, b.first[:-1])
    score = np.add.reduceat(automaton.walk(b.ids, cuts, state), place)
    n = np.diff(b.first)
    base = np.add.reduceat(np.log10((c + 1) / (model["tokens"] + model["types"] + 1))[b.ids], b.first[:-1])
    known = np.add.reduceat((c > 0)[b.ids].astype(np.int64), b.first[:-1])
    return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(len(n), model["tokens"])), pa.array(base), pa.array(score)], names)


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, learned from documents for which ``held`` is false.

    Tokens are the words between ASCII white space, A to Z in lower case, and an end. ``base_score`` is that of the words' counts with one added, ``score`` that of the
    automaton, both in log10. Null and empty texts have the end alone; repeated rows are counted and scored each; a null id stays null; where nothing is
    learned from every word is unknown; an empty table gives no rows; other columns are not read. Words and bigrams are told apart by hashes of 64 bits.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.coalesce(held, F.lit(True)).alias("held_out"), F.spark_partition_id().cast("long").alias("part"))
    blocks = written(rows.mapInArrow(_blocks, "block long, doc_ids array<long>, held_out array<boolean>, sizes binary, words binary, ids binary, tokens long"), "blocks")
    n_tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(n_tokens / BUCKET))
    requests = blocks.select("block", "held_out", "sizes", "words", "ids").mapInArrow(lambda b: _requests(buckets, b), "kind int, bucket long, block long, keys binary, counts binary")
    answers = written(requests.groupBy("kind", "bucket").applyInArrow(_answers, "block long, kind int, bucket long, totals binary, counted long, seen long, once long"), "answers")
    found = {r.kind: r for r in answers.where("block IS NULL").groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("counted", "seen", "once")]).collect()}
    words, pairs = found.get(1), found.get(2)
    model = {"tokens": words.counted if words else 0, "types": words.seen if words else 0, "unseen": pairs.once / pairs.counted if pairs and pairs.counted else 1.0, "prior": prior}
    met = blocks.drop("tokens").groupBy("block").cogroup(answers.where("block IS NOT NULL").select("block", "kind", "bucket", "totals").groupBy("block"))
    return met.applyInArrow(lambda a, b: _scores(model, a, b), SCHEMA)


def op13_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), held_out())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_backoff_scores": op13_backoff_scores}
#: The model's score has no form that SQL computes on whole tables in time; the query is tested against plain counts and a plain walk.
SQL: dict[str, str] = {}
