"""Packing by concatenate and cut.

First pass: each partition tokenises its texts, ends each with an end id and keeps running offsets and its total. The prefix
sums of the totals (one row a partition) place every partition in the whole stream. Second pass: each document's range
of the stream is cut at multiples of the sequence length; a document over a cut leaves boundary records on both sides.
The second pass is DataFrame functions alone.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.buffers import as_bytes, batches_of, hash_lanes, lanes
from quarryline.llm.common import documents, text_of, written

#: White space of one byte; and lead bytes of characters that may be wider white space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Longer pieces aren't remembered; the memory of pieces starts anew beyond this number.
_LONGEST, _MOST = 64, 500_000
#: Bytes of text encoded at once.
_BATCH = 2 << 20


class Pieces:
    """Token ids of many texts at once. A single space between other characters always begins a new word of the vocabulary's
    pattern, so texts are cut there, equal pieces are encoded once, and ids are gathered."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.special = [x.content for x in self.exact.get_added_tokens_decoder().values()]
        self.fast: Callable[[str], list[int]] = lambda text: self.exact.encode(text, add_special_tokens=False).ids
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.size, self.flat = array("q"), array("q"), array("I")

    def _learn(self, piece: bytes) -> int:
        ids = self.fast(piece.decode())
        self.begin.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return len(self.begin) - 1

    @staticmethod
    def _alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Some pieces, and for each piece the place among them of one of equal bytes. Pieces of one hash are compared whole; one that differs from
        the first of its hash stands for itself."""
        values, at = lanes(data, starts, ends)
        _, first, inverse = np.unique(hash_lanes(values, at, ends - starts), return_index=True, return_inverse=True)
        to = first[inverse]
        same = ends - starts == ends[to] - starts[to]
        if same.all():
            place = np.repeat(at[to] - at[:-1], np.diff(at)) + np.arange(len(values))
            same = np.ones(len(to), bool)
            same[np.searchsorted(at, np.flatnonzero(values != values[place]), "right") - 1] = False
        other = np.flatnonzero(~same)
        inverse[other] = len(first) + np.arange(len(other))
        return np.concatenate((first, other)), inverse

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if len(self.begin) > _MOST:
            self._forget()
        data, offsets = as_bytes(texts)
        space = _SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            cut[1:-2] = (data[1:-1] == 32) & ~space[:-2] & ~space[2:]
        whole = {}
        for mark in self.special:
            whole |= {i: self.exact for i in np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False))}
        wide = np.flatnonzero(_WIDE[data])
        wide = wide[~((data[wide] == 0xC2) & ~np.isin(data[np.minimum(wide + 1, len(data) - 1)], (0x85, 0xA0)))] if len(wide) else wide
        for i in np.unique(np.searchsorted(offsets, wide, "right") - 1):
            whole.setdefault(i, None)
        for i in whole:
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        first, inverse = self._alike(data, starts, ends)
        raw = data.tobytes()
        place = np.empty(len(first), np.int64)
        special = {int(offsets[i]): i for i, kind in whole.items() if kind}
        known = self.known
        for k, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
            piece = raw[a:b]
            at = known.get(piece)
            if at is None:
                at = self._learn(piece)
                if b - a <= _LONGEST:
                    known[piece] = at
            place[k] = at
        begin, size, flat = np.frombuffer(self.begin, np.int64), np.frombuffer(self.size, np.int64), np.frombuffer(self.flat, np.uint32)
        at = place[inverse]
        b, n = begin[at], size[at]
        if special:  # texts that hold a special token's string
            ids = [flat[x : x + y] for x, y in zip(b, n, strict=True)]
            for k in np.flatnonzero(np.isin(starts, list(special))):
                ids[k] = np.array(self.exact.encode(raw[starts[k] : ends[k]].decode(), add_special_tokens=False).ids, np.uint32)
            n = np.array([len(x) for x in ids], np.int64)
            out = np.concatenate(ids)
        else:
            total = int(n.sum())
            out = flat[np.repeat(b - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        per = np.zeros(len(texts), np.int64)
        np.add.at(per, np.searchsorted(offsets, starts, "right") - 1, n)
        return out, per


@lru_cache(1)
def _pieces(vocabulary: str, ranks: str | None, pattern: str | None) -> Pieces:
    return Pieces(vocabulary, ranks, pattern)


def tokenize(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, ids`` (little-endian 32 bits each, the end id last), ``doc_tokens``, ``part``, ``part_start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, start = _pieces(vocabulary, ranks, pattern), 0
        for some in batches_of(batches, most=_BATCH):
            ids, sizes = coder.encode(some.column(1))
            ends = np.cumsum(sizes + 1)
            out = np.full(int(ends[-1]), end_id, "<u4")
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            places = np.concatenate(([0], ends)).astype(np.int64) * 4
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), blob, pa.array(sizes + 1), some.column(2), pa.array(start + ends - sizes - 1)], ["doc_id", "ids", "doc_tokens", "part", "part_start"])
            start += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "doc_id long, ids binary, doc_tokens long, part int, part_start long")


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, boundary, ids``.

    The sequences are full but for the last. ``boundary`` marks a piece whose document goes on beyond its sequence, on either side.
    Null text is empty and leaves the end id alone; repeated rows are packed each; a null id stays null; an empty table gives no rows; other columns
    are not read. The broadcast table has one row for each input partition.
    """
    streams = written(tokenize(docs, vocabulary, ranks, pattern, end_id, id_col, text_col), "ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = streams.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    at = F.col("base") + F.col("part_start")
    placed = streams.join(F.broadcast(bases), "part").withColumn("at", at)

    def piece(s):  # noqa: ANN001, ANN202
        lo = F.greatest(F.col("at"), s * length)
        n = F.least(F.col("at") + F.col("doc_tokens"), (s + 1) * length) - lo
        start = lo - F.col("at")
        return F.struct(
            start.alias("start"),
            n.alias("length"),
            s.alias("sequence_id"),
            (lo - s * length).alias("offset"),
            ((start > 0) | (start + n < F.col("doc_tokens"))).alias("boundary"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (n * 4).cast("int")).alias("ids"),
        )

    cuts = F.transform(F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + doc_tokens - 1) div {length}")), piece)
    return placed.select("doc_id", "doc_tokens", cuts.alias("cuts")).select("doc_id", "doc_tokens", F.inline("cuts")).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "boundary", "ids")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")


def public_vocabulary() -> dict[str, str]:
    import public_tokenizers as public

    return {"vocabulary": public.path("byte_bpe_50k.json"), "ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir), **public_vocabulary()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_packing": op8_packing}
#: A tokenizer can't be expressed in SQL; the query is tested against the tokenizer's own encoding.
SQL: dict[str, str] = {}
