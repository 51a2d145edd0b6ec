"""Ranked lexical search over inverted treaps.

1. One pass reads every text and keeps, for each document, its number of terms and the postings of the terms that any query asks for.
   Other terms are counted and go no further.
2. The postings' own rows give the corpus's totals and each asked term's number of documents.
3. A second pass cuts the postings into blocks of documents. In a block each term's postings form a treap: a search tree by document id, a heap by
   impact, so a node's impact bounds all below it. A query walks the treaps of its terms together. A step holds a range of ids and, for each term, the
   highest node in that range; their impacts' sum bounds every document of the range. The document of the greatest of them is scored and parts
   the range in two. Ranges whose bound can't enter the query's best ``k`` are dropped unread. Ranges are taken in order of their bounds, a few of
   each query at a time, all queries at once. A task's blocks share the thresholds reached.
4. The tasks' lists, ``k`` a query each, are merged.

Blocks are cut from rows as they lie, so nothing is shuffled but the lists, and a term of any frequency is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.buffers import batches_of, hash_lanes, lanes, mix64, same_spans, tokens
from quarryline.llm.common import documents, text_of, written

#: Queries of one pass over the documents. A larger set is searched in several.
QUERIES_AT_ONCE = 2_000
#: Postings and documents of one block; ranges of each query that are parted at once.
POSTINGS, DOCUMENTS, AT_ONCE = 2_000_000, 65_536, 32
#: Fixed value: the ASCII characters that no term has are all but digits and letters.
_TERM = np.ones(256, bool)
_TERM[:128] = [chr(i).isalnum() for i in range(128)]
_LOWEST = -(2**63)


class Asked:
    """The terms of some queries: their spans and hashes (ascending), and each query's terms with how often it repeats them."""

    def __init__(self, texts: list[str]) -> None:
        data, starts, ends, first = tokens(pa.array(texts, pa.string()), _TERM)
        names = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        distinct = sorted(set(names))
        joined = np.frombuffer(b"".join(distinct), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(x) for x in distinct]))).astype(np.int64)
        values, lane = lanes(joined, at[:-1], at[1:])
        hashes = hash_lanes(values, lane, np.diff(at))
        order = np.argsort(hashes)
        values, lane = lanes(joined, at[:-1][order], at[1:][order])
        self.hashes, self.values, self.lane = hashes[order], values, lane
        place = {distinct[k]: i for i, k in enumerate(order.tolist())}
        pairs = np.array([(q, place[names[i]]) for q in range(len(texts)) for i in range(first[q], first[q + 1])], np.int64).reshape(-1, 2)
        pairs, times = np.unique(pairs, axis=0, return_counts=True)
        self.query, self.term, self.times = pairs[:, 0], pairs[:, 1], times.astype(np.int64)

    def find(self, values: np.ndarray, lane: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each span's term, -1 if none is asked for. Spans of a term's hash are compared whole with every term that has it."""
        if not len(self.hashes) or not len(lengths):
            return np.full(len(lengths), -1)
        h = hash_lanes(values, lane, lengths)
        found, at = np.full(len(h), -1), np.searchsorted(self.hashes, h)
        spans = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)
        at = at[spans]
        while len(spans):
            same = same_spans(values, lane, spans, self.values, self.lane, at)
            found[spans[same]] = at[same]
            left = ~same & (at + 1 < len(self.hashes))
            spans, at = spans[left], at[left] + 1
            left = self.hashes[at] == h[spans]
            spans, at = spans[left], at[left]
        return found


def _postings(asked: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = max(1, len(asked.hashes))
    for batch in batches_of(batches):
        data, starts, ends, first = tokens(batch.column(1), _TERM)
        term = asked.find(*lanes(data, starts, ends), ends - starts)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        key = np.sort((doc * terms + term)[term >= 0])
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        tf = np.diff(np.concatenate((new, [len(key)])))
        doc, term = np.divmod(key[new], terms)
        offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])


class Treaps:
    """The treaps of a block: nodes are postings in the order of term and document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int) -> None:
        self.doc, self.impact = doc, impact
        self.left, self.right, self.root = np.full(len(doc), -1, np.int64), np.full(len(doc), -1, np.int64), np.full(terms, -1, np.int64)
        # equal impacts are ordered at random, so that many of them don't make a list of the tree
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((mix64(np.arange(len(doc), dtype=np.uint64)), impact))] = np.arange(len(doc))
        cuts = np.searchsorted(term, np.arange(terms + 1))
        for t in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = int(cuts[t]), int(cuts[t + 1])
            left, right = [-1] * (b - a), [-1] * (b - a)
            path: list[tuple[int, int]] = []  # the right edge of the tree so far
            for i, r in enumerate(rank[a:b].tolist()):
                last = -1
                while path and path[-1][0] < r:
                    last = path.pop()[1]
                left[i] = last
                if path:
                    right[path[-1][1]] = i
                path.append((r, i))
            self.root[t] = a + path[0][1]
            for mine, some in ((self.left, left), (self.right, right)):
                x = np.array(some)
                mine[a:b] = np.where(x < 0, -1, x + a)

    def clip(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each node, the highest at or below it in the range of documents; -1 if none."""
        node = node.copy()
        live = np.flatnonzero(node >= 0)
        while len(live):
            at = node[live]
            below, above = self.doc[at] < lo[live], self.doc[at] > hi[live]
            out = below | above
            live, at = live[out], at[out]
            node[live] = np.where(below[out], self.right[at], self.left[at])
            live = live[node[live] >= 0]
        return node


class Best:
    """The best ``k`` of each query so far: score descending, then id ascending."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.query, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))
        # what a document must exceed, or equal with an id below ``last``
        self.least, self.last = np.zeros(queries, np.int64), np.full(queries, _LOWEST)
        self.scored = 0

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.scored += len(query)
        ok = self.enters(query, score, ident)
        if not ok.any():
            return
        q, s, d = (np.concatenate((a, b[ok])) for a, b in ((self.query, query), (self.score, score), (self.ident, ident)))
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < self.k
        self.query, self.score, self.ident = q[keep], s[keep], d[keep]
        full = nth == self.k - 1
        self.least[q[full]], self.last[q[full]] = s[full], d[full]

    def enters(self, query: np.ndarray, bound: np.ndarray, ident: np.ndarray) -> np.ndarray:
        """Whether a document of at most this score and at least this id may be among the best."""
        least = self.least[query]
        return (bound > least) | ((bound == least) & (bound > 0) & (ident < self.last[query]))


def _ragged(first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of the members of some groups."""
    count = first[which + 1] - first[which]
    return np.repeat(first[which] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())


def traverse(treaps: Treaps, ids: np.ndarray, asked: Asked, best: Best) -> None:
    """Walks all queries' treaps over a block of documents of these ids, ascending."""
    node = treaps.root[asked.term]
    query, times, node = asked.query[node >= 0], asked.times[node >= 0], node[node >= 0]
    # ranges: query, lo, hi, bound; and the nodes of each, with the term's repetitions
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(query)), bool), query[1:] != query[:-1])))
    first = np.concatenate((new, [len(query)]))
    query, lo, hi = query[new], np.zeros(len(new), np.int64), np.full(len(new), len(ids) - 1)
    bound = np.add.reduceat(treaps.impact[node] * times, new) if len(new) else np.zeros(0, np.int64)
    width = 1
    while len(query):
        order = np.lexsort((lo, -bound, query))
        chosen = np.sort(order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < width])
        width = min(2 * width, AT_ONCE)  # few at first, until the thresholds have risen
        members = _ragged(first, chosen)
        at, own = node[members], times[members]
        of = np.repeat(np.arange(len(chosen)), np.diff(first)[chosen])
        begin = np.searchsorted(of, np.arange(len(chosen)))
        value = treaps.impact[at] * own
        top = np.flatnonzero(value == np.maximum.reduceat(value, begin)[of])
        doc = treaps.doc[at[top[np.searchsorted(of[top], np.arange(len(chosen)))]]]
        # the document's own score: its nodes are found by going down
        d = doc[of]
        mine = treaps.clip(at, d, d)
        best.add(query[chosen], np.add.reduceat(np.where(mine >= 0, treaps.impact[mine] * own, 0), begin), ids[doc])
        sides = []
        for from_, to in ((lo[chosen], doc - 1), (doc + 1, hi[chosen])):
            part = treaps.clip(at, from_[of], to[of])
            has = part >= 0
            count = np.bincount(of[has], minlength=len(chosen))
            any_ = count > 0
            starts = np.concatenate(([0], np.cumsum(count[any_])))
            most = np.add.reduceat(treaps.impact[part[has]] * own[has], starts[:-1]) if any_.any() else np.zeros(0, np.int64)
            sides.append((query[chosen][any_], from_[any_], to[any_], most, np.diff(starts), part[has], own[has]))
        rest = np.ones(len(query), bool)
        rest[chosen] = False
        kept = _ragged(first, np.flatnonzero(rest))
        parts = [(query[rest], lo[rest], hi[rest], bound[rest], np.diff(first)[rest], node[kept], times[kept]), *sides]
        query, lo, hi, bound, count, node, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        ok = best.enters(query, bound, ids[lo])
        members = _ragged(np.concatenate(([0], np.cumsum(count))), np.flatnonzero(ok))
        query, lo, hi, bound, node, times = query[ok], lo[ok], hi[ok], bound[ok], node[members], times[members]
        first = np.concatenate(([0], np.cumsum(count[ok])))


def block(ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents_: int, length: int) -> tuple[Treaps, np.ndarray]:
    """The treaps of some documents' postings (``sizes`` of each), and the ids in order."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc = np.repeat(place, sizes)
    m = 25 + np.array([75 * x * documents_ // length if length else 0 for x in n.tolist()], np.int64)[order]
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    counts = np.flatnonzero(impact > 0)
    counts = counts[np.argsort(term[counts] * len(ids) + doc[counts], kind="stable")]
    return Treaps(term[counts], doc[counts], impact[counts], len(weight)), ids[order]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """For each query its ``k`` best documents of score above 0: ``item_id, rank, doc_id, score``; equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A to Z in lower case. A document's null or empty text has no
    terms and is never found; it doesn't count as a document. Rows of one id are documents of their own; a null id comes before all others. Of queries of one id the one of least text
    counts; a null or empty query finds nothing. An empty table on either side gives no rows; other columns are not read. Queries are searched ``at_once``
    at a time, about so many by a hash of their ids; these alone come to the driver.
    """
    asked_rows = written(queries.groupBy(F.col(item_col).cast("long").alias("item_id")).agg(F.min(query_col).alias("text")).where("text <> ''"), "queries")
    passes = max(1, math.ceil(asked_rows.count() / at_once))
    found: DataFrame | None = None
    for i in range(passes):
        some = sorted(asked_rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).collect(), key=lambda r: (r.item_id is not None, r.item_id))
        part = _search(docs, [r.item_id for r in some], Asked([r.text for r in some]), k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    # k rows of each task that searched
    own = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, items: list, asked: Asked, k: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc_id"), text_of(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    postings = written(rows.mapInArrow(lambda b: _postings(shared.value, b), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    weight = np.zeros(len(asked.hashes), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each asked term
        weight[r.term] = math.floor(1000 * math.log((2 * totals.documents + 2) / (2 * r.df + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = shared.value, Best(len(items), k)
        held: list[tuple[np.ndarray, ...]] = []
        size = n_docs = 0

        def work() -> None:
            if held:
                traverse(*block(*(np.concatenate(x) for x in zip(*held, strict=True)), weight, totals.documents, totals.length), asked, best)
                held.clear()

        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat = [batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3)]
            per = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            cut = np.concatenate(([0], np.cumsum(per)))
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + POSTINGS - size, "right")) - 1)
                hi = min(hi, lo + DOCUMENTS - n_docs, len(ids))
                held.append((ids[lo:hi], n[lo:hi], per[lo:hi], *(f[cut[lo] : cut[hi]] for f in flat)))
                size, n_docs, lo = size + int(cut[hi] - cut[lo]), n_docs + hi - lo, hi
                if size >= POSTINGS or n_docs >= DOCUMENTS:
                    work()
                    size = n_docs = 0
        work()
        names = np.array(items, object)[best.query] if len(best.query) else np.zeros(0, object)
        yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.int64()), pa.array(best.ident), pa.array(best.score)], ["item_id", "doc_id", "score"])

    return postings.where("size(terms) > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item_id long, doc_id long, score long").withColumn("doc_id", F.nullif("doc_id", F.lit(_LOWEST)))


def op11_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_treap_search": op11_treap_search}
_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {
    "op11_treap_search": f"""
WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS place, doc_id, {_SQL_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
p AS (SELECT place, doc_id, 25 + (75 * len_ * (SELECT n FROM total)) // (SELECT l FROM total) AS m, term, count(*) AS tf
  FROM (SELECT place, doc_id, len(ts) AS len_, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
s AS (SELECT item_id, place, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM p JOIN asked USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
}
