"""Document fingerprints: a sketch scaled by a threshold.

A text's shingles (``width`` consecutive bytes of its UTF-8) are hashed to 64 bits, and every hash below a fixed fraction of
the range is retained. That threshold is the same for all texts, so sketches merge by union, and the containment of one
text in another is estimated from their retained hashes however unequal their lengths are. Short texts retain more, below
fixed larger fractions, as they have few shingles: two texts are compared at the smaller of their fractions.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.buffers import _BYTE, as_bytes, mix64
from quarryline.llm.common import documents, shuffle_partitions, text_of

#: Short enough for texts of a few dozen bytes.
WIDTH = 8
#: What is retained of texts of up to so many shingles; the last holds for all. At six bits a sign a long text's fingerprint has a ninth of its bytes.
FRACTIONS = ((512, 1 / 4), (4_096, 1 / 16), (None, 1 / 48))
Fractions = tuple[tuple[int | None, float], ...]
_BLOCK = 1 << 16
_FIRST = -(2**63)


def shingle_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash at each position; ``width`` is a power of two."""
    with np.errstate(over="ignore"):
        h, step, n = _BYTE[data], np.uint64(0x9E3779B97F4A7C15), 1
        while n < width:
            h = h[:-n] * step + h[n:]
            step, n = step * step, 2 * n
        return mix64(h)


def n_shingles(n_bytes: int, width: int = WIDTH) -> int:
    return max(n_bytes - width + 1, min(1, n_bytes))


def fraction_of(shingles: int, fractions: Fractions = FRACTIONS) -> float:
    """The fraction of the hashes that a text of so many shingles retains."""
    return next(f for most, f in fractions if most is None or shingles <= most)


def cut(sketch: np.ndarray, fraction: float) -> np.ndarray:
    """What of a sketch lies below the fraction."""
    return sketch[: np.searchsorted(sketch, np.uint64(int(fraction * 2**64) - 1), "right")]


def sketches(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, fractions: Fractions = FRACTIONS) -> list[np.ndarray]:
    """The retained hashes of each text, ascending and distinct. A text shorter than ``width`` is one shingle."""
    most = np.uint64(int(max(f for _, f in fractions) * 2**64) - 1)
    places, kept = [], []
    for lo in range(0, max(0, len(data) - width + 1), _BLOCK):
        h = shingle_hashes(data[lo : lo + _BLOCK + width - 1], width)
        at = np.flatnonzero(h <= most)
        places.append(at + lo)
        kept.append(h[at])
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    hashes = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, place, "right") - 1
    whole = place + width <= offsets[doc + 1] if len(place) else np.zeros(0, bool)
    doc, hashes = doc[whole], hashes[whole]
    ends = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        n = offsets[i + 1] - offsets[i]
        if 0 < n < width:
            h = np.array([int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "big")], np.uint64)
        else:
            h = np.unique(hashes[ends[i] : ends[i + 1]])
        out.append(cut(h, fraction_of(n_shingles(int(n), width), fractions)))
    return out


def merged(a: np.ndarray, b: np.ndarray, fraction: float) -> np.ndarray:
    """The sketch of both texts together, at the smaller of their fractions."""
    return np.union1d(cut(a, fraction), cut(b, fraction))


def containment(a: np.ndarray, b: np.ndarray, fraction: float) -> float:
    """The estimated share of the smaller text's shingles that the other has, at the smaller of their fractions; 0 if a sketch is empty there."""
    a, b = cut(a, fraction), cut(b, fraction)
    least = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least if least else 0.0


def _shown(text: bytes, sketch: np.ndarray, width: int) -> str:
    """``<hash of the whole text>:<number of shingles>:<retained hashes in order, the low 32 bits each>``: hexadecimal, the hashes in base 64."""
    low = base64.b64encode(sketch.astype(">u8").view(">u4")[1::2].tobytes()).decode()
    return f"{hashlib.blake2b(text, digest_size=8).hexdigest()}:{n_shingles(len(text), width):x}:{low}"


def _batch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, fractions: Fractions = FRACTIONS) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, fingerprint, hashes`` (the sketch, big-endian 64 bits each). Null text counts as empty and
    has no shingle; equal texts have equal fingerprints; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                data, offsets = as_bytes(some.column(1))
                found, raw = sketches(data, offsets, width, fractions), data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([n_shingles(len(t), width) for t in texts], pa.int64()), pa.array([_shown(t, s, width) for t, s in zip(texts, found, strict=True)], pa.string()), pa.array([s.astype(">u8").tobytes() for s in found], pa.binary())],
                    ["doc_id", "n_shingles", "fingerprint", "hashes"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, fingerprint string, hashes binary")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """``bin, peek, doc_id, text``, sorted in each partition by bin and id, bins of ascending id ranges. The last row of a bin (``peek``) is the first
    document of the next bin, of the first bin after the last: so each document is followed by its successor. None if there are no rows."""
    bins = 4 * shuffle_partitions(docs.sparkSession)
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))
    shares = [i / bins for i in range(1, bins)]
    first, cuts = docs.agg(F.min(order), F.percentile_approx(order, shares, F.lit(100 * bins))).first()
    if first is None:
        return None
    cuts = sorted({first, *cuts})
    table = F.lit(cuts)
    steps = [2**i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.try_element_at(table, at + s) <= F.col("doc_order")), at + s).otherwise(at))
    twice = F.when(F.element_at(table, F.col("bin")) == F.col("doc_order"), F.array(F.struct(F.col("bin"), F.lit(False).alias("peek")), F.struct(F.when(F.col("bin") == 1, F.lit(len(cuts))).otherwise(F.col("bin") - 1).alias("bin"), F.lit(True).alias("peek")))).otherwise(F.array(F.struct(F.col("bin"), F.lit(False).alias("peek"))))
    rows = docs.select(order.alias("doc_order"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("bin", found)
    return (
        rows.select("doc_order", "doc_id", "text", F.explode(twice).alias("place"))
        .select("place.bin", "place.peek", "doc_order", "doc_id", "text")
        .repartition("bin")
        .sortWithinPartitions("bin", "peek", "doc_order", F.xxhash64("text"))
        .select("bin", "peek", "doc_id", "text")
    )


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many of the first of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray], width: int = WIDTH, fractions: Fractions = FRACTIONS) -> float:
    """1 for equal texts, else the containment of the smaller in the larger, at the smaller of their fractions."""
    if a[0] == b[0]:
        return 1.0
    return containment(a[1], b[1], min(fraction_of(n_shingles(len(x), width), fractions) for x in (a[0], b[0])))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, fractions: Fractions = FRACTIONS) -> DataFrame:
    """One row a document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Null text counts as empty, a null id as the lowest; rows of one id are ordered by a hash of the text; a single document follows
    itself. An empty table gives no rows; other columns are not read.
    """
    rows = in_order(docs, id_col, text_col)
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if rows is None:
        return docs.sparkSession.createDataFrame([], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row before, without its successor
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                bins, peeks, ids, texts = (c.to_pylist() for c in batch.slice(lo, 256).columns)
                own = [t.encode() for t in texts]
                found = list(zip(bins, peeks, ids, texts, own, sketches(*_batch(own), width, fractions), strict=True))
                pairs = [(a, b) for a, b in zip(([last] if last else []) + found, found if last else found[1:], strict=False) if not a[1]]
                last = found[-1]
                after = [edited(a[3], b[3]).encode() for a, b in pairs]
                sk = sketches(*_batch(after), width, fractions)
                yield pa.RecordBatch.from_pylist(
                    [
                        {"doc_id": a[2], "n_chars": len(a[3]), "edited_sha256": hashlib.sha256(e).hexdigest(), "fingerprint": _shown(a[4], a[5], width), "edited_fingerprint": _shown(e, s, width), "near_edited": likeness((a[4], a[5]), (e, s), width, fractions), "near_next": likeness((a[4], a[5]), (b[4], b[5]), width, fractions)}
                        for (a, b), e, s in zip(pairs, after, sk, strict=True)
                    ],
                    schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())]),
                )

    return rows.mapInArrow(run, kind)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_fingerprints": op3_fingerprints}
#: The sketch's hash has no SQL function; the query is tested against a brute-force version.
SQL: dict[str, str] = {}
