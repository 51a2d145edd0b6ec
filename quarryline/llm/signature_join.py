"""N-gram Jaccard join by signature trees.

A document's set is its distinct five-word shingles. Two documents link when their Jaccard similarity is 0.8 or more.

1. One pass reads every text: the set's size, digest and signature (a bitmap), and a sketch of how often shingles occur (a fixed number of counters).
2. A second pass emits each set's prefix: the ``n - ceil(0.8 n) + k`` shingles that come first when ordered by sketched
   frequency, rarest first. Sets that link share k shingles of both prefixes, whatever the order; rarest first keeps what many documents share out
   of the prefixes. A set fewer than k of whose keys any other set has links with nothing. Of the rest, sets that share a key meet in the
   bucket of the least of them.
3. Signatures rule out what can't link in a bucket. Each set is tried against the bucket's least document first; sets that may link to it are kept.
   The others meet all of the bucket in signature trees: nodes hold the OR of their sets' bitmaps and the range of their sizes, and trees are
   traversed together, dropping pairs of nodes whose greatest possible overlap is too small. A large bucket is cut into blocks by size, and pairs of
   blocks are traversed in separate tasks; blocks of sets that are all kept already don't meet.
4. What is left is compared, whole set with whole set: with the bucket's least document first; those that link are in one component with
   it and needn't meet each other. The rest meet all of the bucket through trees again.
5. Links and equal sets are joined to components.
6. Where links are counted, all pairs of a bucket that the trees can't rule out are compared, each pair in one of the buckets that it shares, and
   only each set's sum leaves the task.

The test of a pair compares the sets whole, as sets of 64-bit hashes of shingles; words are hashed by ``buffers.hash_lanes``. Keys, buckets and groups of equal sets that hold a large share of the rows are dealt to many tasks: keys by the
sketched frequency, buckets and groups by their counted size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.buffers import as_bytes, batches_of, hash_spans, mix64
from quarryline.llm.common import HOT_SHARE, documents, text_of, with_groups, written
from quarryline.llm.components import components

WORDS, PERCENT = 5, 80
#: Counters of the sketch of frequencies, and rows in which it is gathered: 8 MB in all, however large the input.
COUNTERS, PARTS = 1 << 21, 64
#: Partitions whose counters one task adds.
GATHER = 64
#: Sets of one block of a bucket, children of a tree's node, bits of a signature.
BLOCK, FAN, BITS = 256, 8, 2048
#: A key that at least so many sets have, by the sketch, is dealt to a task for each so many; so is one that holds a share of ``HOT_SHARE`` of all.
SLICE = 4096
#: Bytes of text whose shingles are made at once.
BATCH = 4 << 20
#: Digests that a task remembers so as not to send a set twice.
REMEMBERED = 100_000

_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending in each, and where each text's begin (one more than texts)."""
    data, offsets = as_bytes(texts)
    data = _LOWER[data]
    n = len(offsets) - 1
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _BREAK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~gap[1:-1] & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(~gap[1:-1] & (gap[2:] | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    h = hash_spans(data, starts, ends)
    size = np.diff(first)
    with np.errstate(over="ignore"):
        step = np.uint64(0xD1342543DE82EF95)
        full = max(0, len(h) - words + 1)
        run = np.zeros(full, np.uint64)
        for i in range(words):
            run = run * step + h[i : i + full]
        run = mix64(run)
        out = []
        for a, k in zip(first.tolist(), size.tolist(), strict=False):
            if k >= words:
                out.append(np.unique(run[a : a + k - words + 1]))
            elif k:
                x = np.uint64(k)
                for w in h[a : a + k]:
                    x = x * step + w
                out.append(mix64(np.array([x], np.uint64)))
            else:
                out.append(h[:0])
    return np.concatenate([h[:0], *out]), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for some in batches_of(batches, most=BATCH):
        yield some.column(0).to_pylist(), *shingles(some.column(1), words)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's bitmap (a row of 64-bit words), and how many of its shingles share a bit with another of them."""
    n = len(at) - 1
    bits = np.zeros((n, BITS), bool)
    bits[np.repeat(np.arange(n), np.diff(at)), (h & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, 1).view(np.uint64), np.diff(at) - bits.sum(1)


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _sid(digest: bytes) -> int:
    """The first 64 bits of a set's digest. Sets that share them are candidates together, so a collision loses nothing."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _profile(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    """A row for each document (size, digest and signature of its set), and one for each part of this partition's counters."""
    names = ["doc_id", "n", "digest", "sid", "sign", "slack", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    counts = np.zeros(COUNTERS, np.int32)
    any_ = False
    for ids, h, at in _sets(batches, words):
        any_ = True
        counts += np.bincount(_counter(h), minlength=COUNTERS).astype(np.int32)
        digests = [_digest(h[a:b]) for a, b in zip(at, at[1:], strict=False)]
        signs, slack = signatures(h, at)
        none = [None] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, np.diff(at), digests, [_sid(d) for d in digests], [x.tobytes() for x in signs], slack, none, none), kinds, strict=True)], names)
    if any_:
        for i, some in enumerate(np.split(counts.astype("<u4"), PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((None, None, None, None, None, None, i, some.tobytes()), kinds, strict=True)], names)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // PARTS, np.int64)
    for c in table.column("counts"):
        total += np.frombuffer(c.as_py(), "<u4")
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "src": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def _sketch(parts: DataFrame) -> np.ndarray | None:
    """The sum of all partitions' counters, added ``GATHER`` at a time, so that no task holds more."""
    last = parts.agg(F.max("src")).first()[0]
    if last is None:
        return None
    while True:
        parts = parts.withColumn("src", F.expr(f"src div {GATHER}")).groupBy("part", "src").applyInArrow(_added, "part int, src long, counts binary")
        last //= GATHER
        if not last:
            return np.concatenate([np.frombuffer(r.counts, "<u4") for r in sorted(parts.collect(), key=lambda r: r.part)])
        parts = written(parts, "counters")


def spare_keys(n: int, percent: int = PERCENT) -> int:
    """By how much a prefix is longer than the shortest that shares a key with any set that links, and one."""
    return 1 + (n - (n * percent + 99) // 100) // 2


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Two sets that link have ``ceil(percent n)`` shingles in common at least, n the size of either, so the first ``spare_keys`` of these lie among so
    many first ones of that set."""
    return n - (n * percent + 99) // 100 + spare_keys(n, percent)


def common_keys(n: int, percent: int = PERCENT) -> int:
    """How many keys of its prefix a set shares with any set that links: what the smallest such set can spare, as both prefixes hold the first
    ``spare_keys`` of the smaller one."""
    return spare_keys((n * percent + 99) // 100, percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Both ascending and distinct."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """Sets in the leaves; every node has the OR of the signatures below it and the least and greatest size."""

    def __init__(self, signs: np.ndarray, sizes: np.ndarray, slack: np.ndarray) -> None:
        # a set's own bits may collide, so an overlap is at most the common bits and what collided
        self.levels = [(signs, sizes, sizes, slack)]
        while len(self.levels[-1][1]) > 1:
            s, lo, hi, sl = self.levels[-1]
            cuts = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(s, cuts, 0), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(sl, cuts)))

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> SignatureTree:
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
        signs, slack = signatures(np.concatenate(sets) if sets else np.zeros(0, np.uint64), at)
        return cls(signs, np.diff(at), slack)

    def top(self) -> int:
        return len(self.levels) - 1


def _possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a link: an overlap is at most the common bits plus the collisions on either side, and the least that a link
    needs is percent / (100 + percent) of both sizes; sizes themselves mustn't be too far apart."""
    (sa, la, ha, ca), (sb, lb, hb, cb) = a, b
    most = np.bitwise_count(sa[i] & sb[j]).sum(1) + np.minimum(ca[i], cb[j])
    most = np.minimum(most, np.minimum(ha[i], hb[j]))
    need = percent * (la[i] + lb[j])
    return (100 * np.minimum(ha[i], hb[j]) >= percent * np.maximum(la[i], lb[j])) & ((100 + percent) * most >= need)


def dual(x: SignatureTree, y: SignatureTree, percent: int = PERCENT, same: bool = False) -> Iterator[tuple[int, int]]:
    """Pairs of sets, one of each tree, that the traversal can't rule out; each once if the trees are the ``same``."""
    a, b = x.top(), y.top()
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        ok = _possible(x.levels[a], i, y.levels[b], j, percent)
        i, j = i[ok], j[ok]
        if a == b == 0:
            break
        if a >= b:
            kids = i[:, None] * FAN + np.arange(FAN)
            a -= 1
            j = np.repeat(j, FAN)[(kids < len(x.levels[a][1])).ravel()]
            i = kids[kids < len(x.levels[a][1])]
        else:
            kids = j[:, None] * FAN + np.arange(FAN)
            b -= 1
            i = np.repeat(i, FAN)[(kids < len(y.levels[b][1])).ravel()]
            j = kids[kids < len(y.levels[b][1])]
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        if not same or p < q:
            yield p, q


def join_blocks(left: list[tuple[int, bool, np.ndarray]], right: list[tuple[int, bool, np.ndarray]] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between two blocks of (id, linked to the bucket's least, set), or within one. Pairs that are joined already are passed over:
    the links keep every component whole."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    other = left if right is None else right
    for k, to_least, _ in [*left, *(right or ())]:
        if to_least:
            root[find(k)] = find(-1)
    x = SignatureTree.of([s for _, _, s in left])
    y = x if right is None else SignatureTree.of([s for _, _, s in right])
    for p, q in dual(x, y, percent, right is None):
        a, b = left[p][0], other[q][0]
        if a != b and find(a) != find(b) and linked(left[p][2], other[q][2], percent):
            root[find(a)] = find(b)
            out.append((a, b))
    return out


def _prefixes(counts: np.ndarray, percent: int, words: int, slice_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of late, in this partition: copies needn't be sent again; the shuffle removes the rest
        for _, h, at in _sets(batches, words):
            # counts above, hashes below: rarest first, one order for all sets
            often = counts[_counter(h)]
            key = (np.minimum(often, 65535).astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
            taken, who, need, part = [], [], [], []
            for a, b in zip(at.tolist(), at.tolist()[1:], strict=False):
                digest = _digest(h[a:b])
                if b > a and digest not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    k = prefix_size(b - a, percent)
                    first = np.argpartition(key[a:b], k - 1)[:k]
                    sid = _sid(digest)
                    parts = -(-often[a:b][first].astype(np.int64) // slice_)
                    taken.append(h[a:b][first])
                    who.append(np.full(k, sid))
                    need.append(np.full(k, common_keys(b - a, percent), np.int32))
                    part.append(np.where(parts > 1, 1 + (sid & (2**63 - 1)) % np.maximum(parts, 1), 0).astype(np.int32))
            if taken:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(taken).view(np.int64)), pa.array(np.concatenate(part)), pa.array(np.concatenate(who)), pa.array(np.concatenate(need))], ["shingle", "part", "sid", "need"])

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[list[tuple]]:
    """The rows of each group, of rows sorted by their first ``keys`` columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield rows
                now, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows


def traversals(members: DataFrame, percent: int) -> DataFrame:
    """Which sets meet in which traversal: ``bucket, block, other, side, member, joined`` from ``bucket, member, n, joined``. A bucket of up to ``BLOCK``
    sets is one block; a larger one is cut by size, and by hash where many sets are of one size. Pairs of blocks too far apart in size, or without a
    set that hasn't joined yet, don't meet."""
    count = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("joined")).alias("loose"), F.percentile_approx("n", [i / 64 for i in range(1, 64)], F.lit(256)).alias("cuts"))
    found = written(count.where("loose > 0 AND rows > 1").withColumn("cuts", F.when(F.col("rows") > BLOCK, F.col("cuts"))).drop("loose"), "bucket-sizes")
    sized = written(with_groups(members, found, ["bucket"], "rows"), "members")
    one = sized.where(F.col("rows") <= BLOCK).select("bucket", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("other"), F.lit(0).alias("side"), "member", "joined")
    banded = sized.where(F.col("rows") > BLOCK).withColumn("band", F.expr(f"size(filter(cuts, c -> c < n)) * least(64, ceil(rows / {BLOCK})) div 64")).drop("cuts", "rows")
    in_band = written(banded.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("in_band")), "bands")
    blocks = written(with_groups(banded, in_band, ["bucket", "band"], "in_band").select("bucket", "member", "n", "joined", (F.col("band") * 1_000_000 + F.pmod(F.xxhash64("member"), F.ceil(F.col("in_band") / BLOCK))).alias("block")), "blocks")
    ranges = blocks.groupBy("bucket", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(~F.col("joined")).alias("has_loose"))
    right = ranges.withColumnsRenamed({"block": "other", "lo": "lo2", "hi": "hi2", "has_loose": "loose2"})
    tasks = ranges.join(right, "bucket").where("block <= other AND (has_loose OR loose2)").where(F.expr(f"100 * least(hi, hi2) >= {percent} * greatest(lo, lo2)")).select("bucket", "block", "other")
    sides = tasks.select("bucket", "block", "other", F.explode(F.when(F.col("block") == F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("own", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")))
    return one.unionByName(sides.join(blocks.withColumnRenamed("block", "own"), ["bucket", "own"]).select("bucket", "block", "other", "side", "member", "joined"))


def tried(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """``bucket, member, n, joined`` for each member of a bucket and its least: whether it may link to the least, by their signatures."""
    named = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    least = written(named.join(signs.withColumnsRenamed({"id": "bucket", "n": "to_n", "slack": "to_slack", "sign": "to_sign"}), "bucket"), "least")
    met = with_groups(pairs.join(signs.withColumnRenamed("id", "member"), "member"), least, ["bucket"], "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = []
            for n, slack, sign in ((2, 3, 4), (5, 6, 7)):
                size = batch.column(n).to_numpy()
                levels.append((np.frombuffer(b"".join(batch.column(sign).to_pylist()), np.uint64).reshape(len(size), -1), size, size, batch.column(slack).to_numpy()))
            i = np.arange(batch.num_rows)
            ok = _possible(levels[0], i, levels[1], i, percent) if len(i) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ok, pa.bool_())], ["bucket", "member", "n", "joined"])

    tests = met.select("bucket", "member", "n", "slack", "sign", "to_n", "to_slack", "to_sign").mapInArrow(run, "bucket long, member long, n long, joined boolean")
    return tests.unionByName(least.select("bucket", F.col("bucket").alias("member"), F.col("to_n").alias("n"), F.lit(True).alias("joined")))


def screened(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Of ``bucket, member`` those that may link to another of the bucket by their signatures: to its least, or to one that a traversal of trees finds."""
    first = written(tried(pairs, signs, percent), "tried")
    loaded = traversals(first, percent).join(signs.withColumnRenamed("id", "member"), "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            sides: list[list[tuple]] = [[], []]
            for r in rows:
                sides[r[3]].append(r)
            same = rows[0][1] == rows[0][2]
            trees = [SignatureTree(np.frombuffer(b"".join(r[7] for r in side), np.uint64).reshape(len(side), -1), np.array([r[5] for r in side], np.int64), np.array([r[6] for r in side], np.int64)) for side in sides if side]
            if same or len(trees) == 2:
                other = sides[0 if same else 1]
                hits = {m for p, q in dual(trees[0], trees[0 if same else 1], percent, same) if sides[0][p][4] != other[q][4] for m in (sides[0][p][4], other[q][4])}
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * len(hits), pa.int64()), pa.array(sorted(hits), pa.int64())], ["bucket", "member"])

    met = loaded.select("bucket", "block", "other", "side", "member", "n", "slack", "sign").repartition("bucket", "block", "other").sortWithinPartitions("bucket", "block", "other", "n", "member")
    return met.mapInArrow(run, "bucket long, member long").unionByName(first.where("joined").select("bucket", "member")).where("bucket <> member").distinct()


#: Ids of candidates are broadcast up to this number, 8 bytes each; beyond it texts are shuffled to them.
BROADCAST_IDS = 500_000


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Profiles (``doc_id, n, digest, rep, copies``: the least id with an equal set, and how many have one), the buckets (``bucket, member``) of representatives that may link, and
    their sets (``doc_id, n, digest, sets``); no buckets for an empty table."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), text_of(text_col).alias("text"))
    profile = written(rows.mapInArrow(lambda batches: _profile(batches, words), "doc_id long, n long, digest binary, sid long, sign binary, slack long, part int, counts binary").withColumn("src", F.spark_partition_id().cast("long")), "profiles")
    sets = profile.where("part IS NULL")
    reps = written(sets.groupBy("n", "digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "representatives")
    known = written(with_groups(sets.select("doc_id", "n", "digest", "sid"), reps, ["n", "digest"], "copies"), "known")
    counts = _sketch(profile.where("part IS NOT NULL").select("part", "src", "counts"))
    if counts is None:
        return known, None, None
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    slice_ = max(SLICE, int(counts.sum() * HOT_SHARE))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _prefixes(shared.value, percent, words, slice_)(batches)

    keys = rows.mapInArrow(prefixes, "shingle long, part int, sid long, need int")
    # equal sets of several partitions once, in the shuffle that the keys meet by
    once = keys.repartition("shingle", "part").groupBy("shingle", "part", "sid").agg(F.min("need").alias("need"))
    meet = Window.partitionBy("shingle", "part").orderBy("sid")
    # many sets have a key that is dealt in parts
    some_other = F.lag("sid").over(meet).isNotNull() | F.lead("sid").over(meet).isNotNull() | (F.col("part") > 0)
    own = Window.partitionBy("sid")
    enough = once.withColumn("common", some_other).where("common").withColumn("keys", F.count(F.lit(1)).over(own)).where("keys >= need").select("shingle", "part", "sid")
    least = F.first("sid").over(meet.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = written(enough.withColumn("least", least).where("part > 0 OR sid <> least").select(F.when(F.col("part") > 0, F.col("shingle")).alias("shingle"), "least", "sid").distinct(), "met")
    # fewer keys are dealt in parts than HOT_SHARE's inverse, or than sets by SLICE
    dealt = written(parts.where("shingle IS NOT NULL").groupBy("shingle").agg(F.min("least").alias("first")), "dealt")
    dealt = F.broadcast(dealt) if dealt.count() <= BROADCAST_IDS else dealt
    met = parts.where("shingle IS NULL").select("least", "sid").unionByName(parts.join(dealt, "shingle").where("sid <> first").select(F.col("first").alias("least"), "sid")).distinct()
    name = known.where("n > 0").select("sid", "rep").distinct()
    buckets = met.join(name.withColumnsRenamed({"sid": "least", "rep": "bucket"}), "least").join(name.withColumnRenamed("rep", "member"), "sid")
    # sets that share a sid are one bucket as well
    same = name.groupBy("sid").agg(F.min("rep").alias("bucket"), F.max("rep").alias("last")).where("bucket <> last").join(name.withColumnRenamed("rep", "member"), "sid")
    pairs = buckets.select("bucket", "member").unionByName(same.select("bucket", "member")).where("bucket <> member").distinct()
    pairs = written(pairs, "buckets")
    signs = sets.select(F.col("doc_id").alias("id"), "n", "slack", "sign")
    pairs = written(screened(pairs, signs, percent), "screened")
    # the texts of candidates alone
    wanted = written(pairs.select(F.col("bucket").alias("doc_id")).unionByName(pairs.select(F.col("member").alias("doc_id"))).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    some = written(rows.join(wanted, "doc_id", "left_semi").mapInArrow(lambda batches: _whole(batches, words), "doc_id long, n long, digest binary, sets binary"), "sets")
    return known, pairs, some


def spanning_links(pairs: DataFrame, some: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (``a, b``) that keep every component whole; not all links."""
    # first each member against its bucket's least
    with_sets = pairs.join(some.select(F.col("doc_id").alias("member"), F.col("sets").alias("own")), "member").join(some.select(F.col("doc_id").alias("bucket"), F.col("sets").alias("to")), "bucket")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, to = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(own, to, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 8 for x in own], pa.int64()), pa.array(ok, pa.bool_())], ["bucket", "member", "n", "joined"])

    star = written(with_sets.select("bucket", "member", "own", "to").mapInArrow(stars, "bucket long, member long, n long, joined boolean"), "star")
    links = star.where("joined").select(F.col("bucket").alias("a"), F.col("member").alias("b"))
    # then what didn't link to it against all members
    loaded = traversals(star, percent).join(some.select(F.col("doc_id").alias("member"), "n", "sets"), "member")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in groups(batches):
            both: list[list] = [[], []]
            for _, _, _, side, member, joined, _, raw in found:
                both[side].append((member, joined, np.frombuffer(raw, np.uint64)))
            same = found[0][1] == found[0][2]
            links = join_blocks(both[0], None if same else both[1], percent) if both[0] and (same or both[1]) else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    more = loaded.select("bucket", "block", "other", "side", "member", "joined", "n", "sets").repartition("bucket", "block", "other").sortWithinPartitions("bucket", "block", "other", "n", "member").mapInArrow(rest, "a long, b long")
    return links.unionByName(more)


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Profiles (``doc_id, n, digest, rep``: the least id with an equal set) and links (``a, b``) between representatives, as many as keep every
    component whole. ``link_counts`` counts all of them."""
    known, pairs, some = candidates(docs, id_col, text_col, words, percent)
    return known, _spanned(known, pairs, some, percent)


def _spanned(known: DataFrame, pairs: DataFrame | None, some: DataFrame | None, percent: int) -> DataFrame:
    return known.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false") if pairs is None else spanning_links(pairs, some, percent)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], rows: list[int]) -> Iterator[np.ndarray]:
    """For each of ``rows`` of ``left``, how many members its set has in common with each set of ``right``."""
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(right)), [len(s) for s in right])[order]
    for p in rows:
        lo, hi = np.searchsorted(values, left[p], "left"), np.searchsorted(values, left[p], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        yield np.bincount(owner[at], minlength=len(right))


def block_counts(bucket: int, left: list[tuple], right: list[tuple] | None, percent: int = PERCENT) -> dict[tuple[int, bytes], int]:
    """By (id, digest), how many documents link to a set of two blocks, or of one, of (id, digest, copies, buckets, set). A pair counts in the least bucket that both are in."""
    same = right is None
    other = left if same else right
    sets, others = [r[4] for r in left], [r[4] for r in other]
    x = SignatureTree.of(sets)
    y = x if same else SignatureTree.of(others)
    few: dict[int, list[int]] = {}
    for p, q in dual(x, y, percent, same):
        if left[p][0] != other[q][0]:
            few.setdefault(p, []).append(q)
    least, least2 = [min(r[3]) for r in left], [min(r[3]) for r in other]
    out: dict[tuple[int, bytes], int] = {}
    for (p, qs), both in zip(few.items(), overlaps(sets, others, list(few)), strict=True):
        a = left[p]
        for q, m in zip(qs, both[qs].tolist(), strict=True):
            b = other[q]
            if 100 * m >= percent * (len(a[4]) + len(b[4]) - m) and (bucket == max(least[p], least2[q]) or bucket == min(a[3] & b[3])):
                out[a[:2]] = out.get(a[:2], 0) + b[2]
                out[b[:2]] = out.get(b[:2], 0) + a[2]
    return out


def link_counts(known: DataFrame, pairs: DataFrame, some: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rep, digest, linked``: how many documents have another set that links to the representative's. Every pair of a bucket that the trees can't rule
    out is compared. Ids are those of one text each; repeated rows count as copies."""
    copies = known.select(F.col("rep").alias("doc_id"), "n", "digest", "copies").distinct()
    members = written(pairs.unionByName(pairs.select("bucket", F.col("bucket").alias("member")).distinct()), "bucket-members")
    homes = members.groupBy("member").agg(F.collect_set("bucket").alias("homes"))
    nodes = written(some.dropDuplicates(["doc_id", "n", "digest"]).join(copies, ["doc_id", "n", "digest"]).withColumnRenamed("doc_id", "member").join(homes, "member"), "nodes")
    met = traversals(members.join(nodes.select("member", "n"), "member").withColumn("joined", F.lit(False)), percent).drop("joined").join(nodes, "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in groups(batches):
            both: list[list] = [[], []]
            for _, _, _, side, member, _, digest, n_copies, buckets, raw in found:
                both[side].append((member, digest, n_copies, frozenset(buckets), np.frombuffer(raw, np.uint64)))
            same = found[0][1] == found[0][2]
            sums = block_counts(found[0][0], both[0], None if same else both[1], percent) if both[0] and (same or both[1]) else {}
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.binary()), pa.array(list(sums.values()), pa.int64())], ["rep", "digest", "linked"])

    dealt = met.select("bucket", "block", "other", "side", "member", "n", "digest", "copies", "homes", "sets").repartition("bucket", "block", "other").sortWithinPartitions("bucket", "block", "other", "n", "member")
    return dealt.mapInArrow(run, "rep long, digest binary, linked long").groupBy("rep", "digest").agg(F.sum("linked").alias("linked"))


def _whole(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    for ids, h, at in _sets(batches, words):
        sets = [h[a:b] for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(at)), pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "n", "digest", "sets"])


def _id(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(-(2**63))).alias(c if isinstance(c, str) else "id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, set_copies`` (documents with an equal set), with ``count_links`` also ``n_links``: how many
    other documents link to it, those with an equal set among them.

    Null and empty texts have no set and are alone in their component. Repeated rows are in one component. Null ids are one document, of the
    lowest id, shown as null. An empty table gives no rows; other columns are not read.
    """
    known, pairs, some = candidates(docs, id_col, text_col, words, percent)
    named = components(_spanned(known, pairs, some, percent))
    # one row for each set, so that its documents meet the answers once
    sets = known.select("rep", "n", "digest", "copies").distinct().join(named.withColumnRenamed("node", "rep"), "rep", "left")
    shown = [_id("doc_id"), F.col("n").alias("n_shingles"), _id(F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))).alias("component_id"), F.col("copies").alias("set_copies")]
    if count_links:
        none = known.select("rep", "digest", F.lit(0).cast("long").alias("linked")).where("false")
        sets = sets.join(none if pairs is None else link_counts(known, pairs, some, percent), ["rep", "digest"], "left")
        shown.append(F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    rows = with_groups(known.select("doc_id", "rep", "n", "digest"), written(sets, "answers"), ["rep", "n", "digest"], "copies")
    return rows.select(*shown)


def keep_one_of_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each group of near copies, that of least id; all columns as they were, whatever their names. Documents without a set (null or
    empty texts, white space alone) stay; of repeated rows one stays; rows of one id (null ids are one) with different texts stay or go together; an
    empty table gives no rows."""
    lowest = F.lit(-(2**63))
    kept = jaccard_components(docs).where("doc_id <=> component_id").select(F.coalesce("doc_id", lowest).alias("order")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("order"), F.xxhash64(text_of()).alias("print"), (F.length(text_of()) == 0).alias("empty"))
    one = Window.partitionBy("order", "print").orderBy("order")
    return rows.join(kept, "order", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1 OR empty").select("doc.*")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_ngram_jaccard": op10_ngram_jaccard}
#: All pairs of sets and a transitive closure are too slow in SQL on whole tables; the query is tested against brute force.
SQL: dict[str, str] = {}
