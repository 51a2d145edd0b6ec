"""Secrets by a linear-chain conditional random field.

Texts are cut into tokens, and each is tagged as the begin of a secret, inside one, or outside. Features are the token's shape, how its letters and
digits alternate, its word, the two words before and the one after, and the file's shares of digits and signs. The field is trained by gradient
ascent of the conditional likelihood (forward and backward sums) on a bounded sample of documents, tagged by the base patterns, and
decoded by Viterbi. A token whose emission favours outside by more than transitions could ever win back is outside on the best path, so only the stretches between such
tokens need the recursion; all stretches of a batch are decoded in step. The result is that of the whole text's Viterbi path.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.buffers import batches_of, mix64
from quarryline.llm.common import documents, text_of

#: About so many documents are drawn by a hash of their id and text. Those of least hash are learned from: at most so many with base spans and so many
#: without, each by at most so many of its first characters. Training alone is bounded; all documents are searched whole.
SAMPLE, WITH_SPANS, WITHOUT_SPANS, SAMPLE_CHARS = 2_000, 300, 300, 40_000
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
#: A text without any of these, in lower case, has no assignment.
_KEYS = (b"passw", b"secret", b"token", b"api")
#: Bytes of text searched at once.
BATCH = 1 << 20
_TAGS, _BUCKETS, _FEATURES = 3, 4096, 8
BEGIN, INSIDE, OUTSIDE = 0, 1, 2


def base_spans(text: str, long_hex: bool = True) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind. ``long_hex``: whether there may be a run of 24 hexadecimal digits."""
    low = text.encode("utf-8", "surrogatepass").lower()
    found = []
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if long_hex:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


class Tokens:
    """The tokens of many texts: where they begin and end in all texts together, their text, their features."""

    def __init__(self, texts: list[str]) -> None:
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(code, 128).astype(np.uint8)
        kind = _CLASS[small]  # 0 space, 1 lower, 2 upper, 3 digit, 4 joining sign, 5 above ASCII, 6 other sign
        word = (kind > 0) & (kind < 6)
        edge = np.zeros(len(code) + 1, bool)
        edge[self.offsets] = True
        n = len(code)
        new = np.ones(n, bool)
        new[1:] = (word[1:] != word[:-1]) | (kind[1:] == 0) | (kind[:-1] == 0) | edge[1:n] if n else False
        starts = np.flatnonzero(new & (kind > 0))
        stops = np.flatnonzero(np.append(new, True))
        ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
        self.starts, self.ends = starts, ends
        self.doc = np.searchsorted(self.offsets, starts, "right") - 1
        sums = [np.concatenate(([0], np.cumsum(m, dtype=np.int32))) for m in (kind == 1, kind == 2, kind == 3, kind == 4, kind == 5, _HEXES[small])]
        flips = np.zeros(n, bool)
        flips[1:] = (kind[1:] == 3) != (kind[:-1] == 3)
        flips = np.concatenate(([0], np.cumsum(flips, dtype=np.int32)))
        per = [s[ends] - s[starts] for s in sums]
        self.hex_run = per[5]
        size = ends - starts
        length = np.digitize(size, (2, 4, 6, 9, 13, 20, 28, 48))
        bits = sum((p > 0).astype(np.int64) << i for i, p in enumerate(per[:5])) + ((per[5] == size).astype(np.int64) << 5)
        turns = np.minimum(flips[ends] - flips[np.minimum(starts + 1, n)], 7) if n else size
        words = self._words(_SMALL[small].astype(np.uint64) + (code.astype(np.uint64) & ~np.uint64(127)) * (code > 127), starts, ends)
        ids = np.where(size <= 24, words & np.uint64(_BUCKETS - 1), np.uint64(0)).astype(np.int64)
        total = np.maximum(np.diff(self.offsets), 1)
        file = np.minimum(10 * (sums[2][self.offsets[1:]] - sums[2][self.offsets[:-1]]) // total, 7) * 8
        signs = np.concatenate(([0], np.cumsum(kind == 6, dtype=np.int32)))
        file += np.minimum(20 * (signs[self.offsets[1:]] - signs[self.offsets[:-1]]) // total, 7)
        self.features = np.stack([length * 64 + bits, length * 64 + turns * 8 + np.minimum(8 * per[2] // np.maximum(size, 1), 7), ids, self._near(ids, 1), self._near(ids, 2), self._near(ids, -1), file[self.doc] if len(self.doc) else self.doc, np.zeros(len(starts), np.int64)])

    def _words(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        from quarryline.llm.buffers import _BASE, _powers

        with np.errstate(over="ignore"):
            n = len(low) + 1
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * _powers(_BASE, n)[:-1])))
            return mix64((sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 2**64), n)[starts])

    def _near(self, ids: np.ndarray, back: int) -> np.ndarray:
        """The word ``back`` tokens before in the same text, else 0."""
        out = np.zeros(len(ids), np.int64)
        if back > 0:
            out[back:] = np.where(self.doc[back:] == self.doc[:-back], ids[:-back], 0)
        else:
            out[:back] = np.where(self.doc[:back] == self.doc[-back:], ids[-back:], 0)
        return out


_CLASS = np.full(129, 6, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "+/_-."]] = 4
_CLASS[128] = 5
_HEXES = np.zeros(129, bool)
_HEXES[[ord(c) for c in "0123456789abcdef"]] = True
_SMALL = np.arange(129, dtype=np.uint8)
_SMALL[65:91] += 32


def tags(tokens: Tokens, spans: list[list[tuple[int, str, int]]], texts: list[str]) -> np.ndarray:
    """The tags that the base spans give; of an assignment, the value alone is the secret."""
    out = np.full(len(tokens.starts), OUTSIDE)
    for i, found in enumerate(spans):
        for a, kind, b in found:
            if kind == "assign":
                a = ASSIGN.match(texts[i], a).start(2)
            at = np.arange(*np.searchsorted(tokens.starts, (tokens.offsets[i] + a, tokens.offsets[i] + b)))
            if len(at):
                out[at] = INSIDE
                out[at[0]] = BEGIN
    return out


class Field:
    """Weights: feature x bucket x tag, and tag x tag transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], _TAGS))
        for w, f in zip(self.weights, features, strict=True):
            out += w[f]
        return out

    def margin(self) -> float:
        return 2 * float(self.moves.max() - self.moves.min())

    def decode(self, emissions: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best path of each text."""
        n = len(emissions)
        out = np.full(n, OUTSIDE)
        open_ = np.flatnonzero(emissions[:, OUTSIDE] - emissions[:, :OUTSIDE].max(1) <= self.margin()) if n else np.zeros(0, np.int64)
        if not len(open_):
            return out
        begin = np.ones(len(open_), bool)
        begin[1:] = (np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])
        first = open_[begin]
        size = np.diff(np.append(np.flatnonzero(begin), len(open_)))
        # whether a certain token precedes and follows in the same text
        before = (first > 0) & (doc[np.maximum(first - 1, 0)] == doc[first])
        last = first + size - 1
        after = (last < n - 1) & (doc[np.minimum(last + 1, n - 1)] == doc[last])
        order = np.argsort(-size, kind="stable")
        first, size, before, after = first[order], size[order], before[order], after[order]
        back = np.zeros((n, _TAGS), np.uint8)
        score = emissions[first] + np.where(before[:, None], self.moves[OUTSIDE][None, :], 0.0)
        for t in range(1, size[0]):
            k = int(np.searchsorted(-size, -t, "left"))
            via = score[:k, :, None] + self.moves[None]
            at = first[:k] + t
            back[at] = via.argmax(1)
            score[:k] = via.max(1) + emissions[at]
        tag = (score + np.where(after[:, None], self.moves[:, OUTSIDE][None, :], 0.0)).argmax(1)
        for t in range(size[0] - 1, -1, -1):
            k = int(np.searchsorted(-size, -t, "left"))
            at = first[:k] + t
            out[at] = tag[:k]
            tag[:k] = back[at, tag[:k]]
        return out


def train(features: np.ndarray, gold: np.ndarray, doc: np.ndarray, rounds: int = 40, rate: float = 0.3, decay: float = 1e-4, bound: float = 2.0) -> Field:
    """Adagrad on the mean log likelihood of windows of 64 tokens. Transitions stay within ``bound`` of 0."""
    window = 64
    n = features.shape[1]
    place = np.arange(n) - np.searchsorted(doc, doc)
    begin = place % window == 0
    first = np.flatnonzero(begin)
    size = np.diff(np.append(first, n))
    where = np.minimum(first[:, None] + np.arange(window), n - 1)
    live = np.arange(window) < size[:, None]
    weights, moves = np.zeros((_FEATURES, _BUCKETS, _TAGS)), np.zeros((_TAGS, _TAGS))
    seen_w, seen_m = np.full(weights.shape, 1e-6), np.full(moves.shape, 1e-6)
    truth = np.eye(_TAGS)[gold]
    pairs = np.zeros((_TAGS, _TAGS))
    follow = np.flatnonzero(~begin)
    np.add.at(pairs, (gold[follow - 1], gold[follow]), 1)
    for _ in range(rounds):
        field = Field(weights, moves)
        e = np.where(live[:, :, None], field.emissions(features)[where], 0.0)
        trans = np.exp(moves)
        alpha, beta, scale = np.zeros(e.shape), np.ones(e.shape), np.ones(e.shape[:2])
        p = np.exp(e - e.max(2, keepdims=True))
        for t in range(window):
            a = p[:, t] if t == 0 else (alpha[:, t - 1] @ trans) * p[:, t]
            scale[:, t] = a.sum(1)
            alpha[:, t] = a / scale[:, t : t + 1]
        for t in range(window - 2, -1, -1):
            b = (p[:, t + 1] * beta[:, t + 1]) @ trans.T / scale[:, t + 1 : t + 2]
            beta[:, t] = np.where(live[:, t + 1 : t + 2], b, 1.0)
        post = alpha * beta
        post = post / post.sum(2, keepdims=True)
        flat = np.zeros((n, _TAGS))
        flat[where[live]] = post[live]
        both = (alpha[:, :-1, :, None] * trans[None, None] * (p * beta)[:, 1:, None, :]) / scale[:, 1:, None, None]
        grad_m = (pairs - (both * live[:, 1:, None, None]).sum((0, 1))) / n
        moves = moves + rate * grad_m / np.sqrt(seen_m := seen_m + grad_m**2)
        moves = np.clip(moves, -bound, bound)
        error = (truth - flat) / n
        for i in range(_FEATURES):
            g = np.stack([np.bincount(features[i], error[:, k], _BUCKETS) for k in range(_TAGS)], 1) - decay * weights[i] / n
            seen_w[i] += g**2
            weights[i] += rate * g / np.sqrt(seen_w[i]) * (g != 0)
    return Field(weights, moves)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, with_spans: int = WITH_SPANS, without: int = WITHOUT_SPANS, chars: int = SAMPLE_CHARS) -> Field:
    """From some of about ``sample`` documents drawn: the first ``with_spans`` with base spans and ``without`` others in the order of their hash, ``chars``
    characters of each. Copies of one text and id share a hash; of all of these the first ``2 * sample`` are drawn at most."""
    n = docs.count()
    text = text_of(text_col)
    name = F.concat_ws("|", F.lit("secret:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.crc32(text.cast("binary")))
    draw = F.crc32(name.cast("binary")) / float(2**32)
    drawn = docs.select(draw.alias("draw"), F.substring(text, 1, chars).alias("text")).where(F.col("draw") < min(1.0, sample / max(1, n)))
    rows = drawn.orderBy("draw", "text").limit(2 * sample).collect()
    kept, others = [], []
    for r in sorted(rows, key=lambda r: (r.draw, r.text)):
        spans = base_spans(r.text)
        (kept if spans else others).append((r.text, spans))
    kept = kept[:with_spans] + others[:without]
    texts = [t for t, _ in kept]
    tokens = Tokens(texts)
    if not len(tokens.starts):
        return Field(np.zeros((_FEATURES, _BUCKETS, _TAGS)) + np.array([0, 0, 1.0]), np.zeros((_TAGS, _TAGS)))
    return train(tokens.features, tags(tokens, [s for _, s in kept], texts), tokens.doc)


def find(texts: list[str], field: Field) -> list[list[tuple[int, str, int]]]:
    """The spans of each text: the base ones, and those of the field that meet none of them."""
    tokens = Tokens(texts)
    path = field.decode(field.emissions(tokens.features), tokens.doc)
    long_hex = np.zeros(len(texts) + 1, bool)
    long_hex[tokens.doc[tokens.hex_run >= 24]] = True
    found = [base_spans(t, bool(long_hex[i])) for i, t in enumerate(texts)]
    hot = np.flatnonzero(path != OUTSIDE)
    new = np.ones(len(hot), bool)
    new[1:] = (np.diff(hot) > 1) | (path[hot[1:]] == BEGIN) | (tokens.doc[hot[1:]] != tokens.doc[hot[:-1]])
    at = np.append(np.flatnonzero(new), len(hot))
    added: dict[int, list[tuple[int, str, int]]] = {}
    for a, b in zip(at, at[1:], strict=False):
        i = int(tokens.doc[hot[a]])
        added.setdefault(i, []).append((int(tokens.starts[hot[a]] - tokens.offsets[i]), "crf", int(tokens.ends[hot[b - 1]] - tokens.offsets[i])))
    for i, spans in added.items():
        found[i] += apart(spans, found[i])
    return [sorted(f, key=lambda s: (s[0], KINDS.index(s[1]))) for f in found]


def apart(spans: list[tuple[int, str, int]], others: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Those of ``spans``, which don't meet each other, that meet none of ``others``: of the others that begin before a span's end none ends after its start."""
    others = sorted(others)
    starts, ends = [s for s, _, _ in others], list(accumulate((e for _, _, e in others), max))
    return [x for x in spans if not (k := bisect_left(starts, x[2])) or ends[k - 1] <= x[0]]


def secret_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, found`` (kind, start, end in code points, value), by start, then kind.

    Null text counts as empty; repeated rows are searched each; an empty table gives no rows; other columns are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches_of(batches, most=BATCH):
            texts = some.column(1).to_pylist()
            rows = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, k, b in f] for t, f in zip(texts, find(texts, field), strict=True)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind string, start long, end long, value string>>")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    spans = secret_spans(docs, learn(docs))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(F.filter("found", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), shown("found").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_secrets": op4_secrets}
#: A trained field can't be expressed in SQL; the query is tested against plain patterns and a plain Viterbi.
SQL: dict[str, str] = {}
