"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A document descends the tree. At each node every child draws an exponential variate, from the hash of (seed, node, child, key), of
the rate of its whole subtree's weight, and the descent goes on in the child of the least draw: the children get documents in
proportion to their weights. A document costs one hash for each child of the nodes on its way, not one for each shard.

Where weights change, only the draws of the subtrees that hold the change are rescaled: documents move into subtrees that gained
weight or out of those that lost some, and in every other subtree nothing moves. A new shard that opens a region of its own
is such a subtree, and the only one, so all that moves goes into it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import documents, text_of, written

#: A topology is a list of (region, rack, shard, weight).
Topology = list[tuple[int, int, int, float]]


def balanced_topology(shards: int, racks: int = 4, per_region: int = 2) -> Topology:
    """Shards of one weight dealt over racks by number, racks over regions."""
    return [(s % racks // per_region, s % racks, s, 1.0) for s in range(shards)]


def with_region(topology: Topology, shard: int, weight: float = 1.0) -> Topology:
    """The topology and one more shard, in a rack and a region of its own."""
    return [*topology, (1 + max(t[0] for t in topology), 1 + max(t[1] for t in topology), shard, weight)]


def takes_into_new_alone(topology: Topology, grown: Topology) -> bool:
    """Whether the growth only adds regions, so that documents move into new shards alone."""
    old = {t[0] for t in topology}
    return sorted(topology) == sorted(t for t in grown if t[0] in old)


def draw(key: Column, node: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u uniform over (0, 1) from 52 bits of MD5 of (seed, node, key)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), node, key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def descend(key: Column, topology: Topology, seed: str = "shards") -> Column:
    """The shard that the descent reaches."""
    tree: dict[int, dict[int, dict[int, float]]] = {}
    for region, rack, shard, weight in sorted(topology):
        if weight > 0:
            tree.setdefault(region, {}).setdefault(rack, {})[shard] = weight
    if not tree:
        raise ValueError("no shard has a positive weight")
    # the whole tree as one constant: children of the root, of each of them, and shards
    node = lambda name, weight, **below: F.struct(F.lit(name).alias("node"), F.lit(float(weight)).alias("weight"), *[v.alias(k) for k, v in below.items()])
    regions = F.array(
        *[
            node(f"{g}", sum(sum(s.values()) for s in racks.values()), below=F.array(*[node(f"{g}.{r}", sum(shards.values()), below=F.array(*[node(f"{g}.{r}.{s}", w, shard=F.lit(s)) for s, w in shards.items()])) for r, shards in racks.items()]))
            for g, racks in tree.items()
        ]
    )

    def least(children: Column, value: str) -> Column:
        return F.array_min(F.transform(children, lambda c: F.struct(draw(key, c["node"], c["weight"], seed).alias("draw"), c[value].alias("value"))))["value"]

    return least(least(least(regions, "below"), "below"), "shard")


def slots(placed: DataFrame, group: str = "shard", order: tuple[str, ...] = ("doc_id", "text_crc32", "size"), rows_per_bin: int = 65_536) -> DataFrame:
    """``placed``, all of whose columns the group and ``order`` decide, with ``slot``: 0, 1, … without gaps in each group, in the order of a
    hash. Equal rows are counted, not gathered, and get their slots where they are expanded. A group is cut into bins by the
    hash, and the bins' prefix sums place each, so a group of any size is numbered by many tasks."""
    n = placed.count()
    digits = max(2, math.ceil(math.log(max(1, n / rows_per_bin), 16)) + 1)
    name = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    kinds = placed.withColumn("name", name).groupBy(*placed.columns, "name").agg(F.count(F.lit(1)).alias("copies")).withColumn("bin", F.substring("name", 1, digits))
    kinds = written(kinds, "kinds")
    before = Window.partitionBy(group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = kinds.groupBy(group, "bin").agg(F.sum("copies").alias("rows")).select(group, "bin", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy(group, "bin").orderBy("name", *order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum("copies").over(own), F.lit(0))
    first = kinds.join(bases, [group, "bin"]).withColumn("at", at)
    # in blocks, so that no array holds all of a large group
    blocks = first.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(4096))))
    nth = F.explode(F.sequence(F.col("at") + F.col("block"), F.col("at") + F.least(F.col("block") + 4096, F.col("copies")) - 1))
    return blocks.select(*placed.columns, nth.alias("slot"))


def shard_documents(docs: DataFrame, topology: Topology, grown: Topology | None = None, id_col: str = "doc_id", text_col: str = "text", seed: str = "shards") -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``key``: the id and the topology alone decide. A ``grown`` topology that does more than add regions raises an error, as documents would
    move between old shards too. A null id has the key of the empty text; a null text has size 1. Repeated rows each get
    a slot. An empty table gives no rows. Other columns are not read.
    """
    if grown and not takes_into_new_alone(topology, grown):
        raise ValueError("the grown topology changes old regions")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = text_of(text_col)
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, topology, seed).alias("shard"),
        (descend(key, grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return slots(written(placed, "placed")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: Two regions of two racks of two shards; a ninth shard opens a region.
EIGHT = balanced_topology(8)
NINE = with_region(EIGHT, 8)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), EIGHT, NINE)


def _sql_draw(node: str, weight: float) -> str:
    return f"-ln((('0x' || md5('shards|{node}|' || key)[1:13])::BIGINT + 0.5) / {2**52}.0) / {weight}"


def _sql_descend(topology: Topology) -> str:
    """Level by level: the child of least draw."""

    def least(choices: list[tuple[str, str, float]]) -> str:
        """Of (result, node, weight)."""
        return "list_min([" + ", ".join(f"{{'d': {_sql_draw(n, w)}, 'v': {v}}}" for v, n, w in choices) + "]).v"

    weight = lambda *path: sum(t[3] for t in topology if t[: len(path)] == path)
    inner = []
    for g in sorted({t[0] for t in topology}):
        racks = []
        for r in sorted({t[1] for t in topology if t[0] == g}):
            racks.append((least([(str(s), f"{g}.{r}.{s}", w) for g2, r2, s, w in topology if (g2, r2) == (g, r)]), f"{g}.{r}", weight(g, r)))
        inner.append((least(racks), f"{g}", weight(g)))
    return least(inner)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_sharding": op9_sharding}
#: CRC-32: the remainder of each byte (eight halvings), a fold over the bytes of each block of 256, and a fold over blocks, where a state passes 256 zero
#: bytes by the sum of what each of its four bytes becomes. The first block takes the odd bytes.
SQL: dict[str, str] = {
    "op9_sharding": f"""
WITH t AS (SELECT list(r ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS r FROM range(256) x(i))),
z AS (SELECT list(r ORDER BY i) AS zero FROM (SELECT i, list_reduce([(i % 256) << (8 * (i // 256))] || range(256), lambda a, b: xor(a // 256, tab[1 + a % 256])) AS r FROM range(1024) x(i), t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) AS nb, hex(encode(coalesce(text, ''))) AS hx FROM documents),
p AS (SELECT rid, k, hx[2 * greatest(0, f + 256 * (k - 1)) + 1:2 * (f + 256 * k)] AS part FROM (SELECT rid, hx, (nb + 255) % 256 + 1 AS f, unnest(range(greatest(1, (nb + 255) // 256))) AS k FROM d)),
b AS (SELECT rid, k, list_reduce([CASE WHEN k = 0 THEN 4294967295 ELSE 0 END] || list_transform(range(len(part) // 2), lambda i: ('0x' || part[2 * i + 1:2 * i + 2])::BIGINT), lambda a, x: xor(a // 256, tab[1 + xor(a % 256, x)])) AS crc FROM p, t),
g AS (SELECT rid, list(crc ORDER BY k) AS crcs FROM b GROUP BY rid),
c AS (SELECT doc_id, key, nb, xor(4294967295, list_reduce(crcs, lambda a, x: xor(x, xor(xor(zero[1 + a % 256], zero[257 + a // 256 % 256]), xor(zero[513 + a // 65536 % 256], zero[769 + a // 16777216]))))) AS crc FROM g JOIN d USING (rid), z)
SELECT doc_id, nb + 1 AS size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', key, crc, nb + 1)), doc_id, crc, nb) - 1 AS slot, grown_shard
FROM (SELECT *, ({_sql_descend(EIGHT)})::INT AS shard, ({_sql_descend(NINE)})::INT AS grown_shard FROM c)
"""
}
