"""Mixing sources to target weights over a tree of levels (domain, language, source).

A token budget flows down the tree: each node shares its budget among its children by weight, never more than a
child's subtree holds (``max_epochs`` times its tokens). What a child can't use goes to its siblings by weight, and
since a node's own share never exceeds what its subtree holds, a shortage reaches the ancestors' siblings only when all
siblings are full. The share is water filling in closed form: children sorted by capacity / weight, the water level is
the greatest of (budget - capacity before) / (weight not before). Each leaf then takes whole epochs and a prefix of
one more; every epoch has its own seeded order. The prefix is found by binning the order, so no leaf is sorted whole,
and the documents are filtered against one row for each leaf: their texts never move. Only rows equal in id and text share a
place in the order; where a leaf's prefix ends among such rows, they alone are written and numbered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import documents, text_of, written

LEVELS = ("domain", "lang", "source")
#: Leaves are broadcast up to this number of rows, of some 200 bytes each; beyond it they are joined.
BROADCAST_LEAVES = 100_000


def words(text_col: str = "text") -> Column:
    """Tokens of a text: its words, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def _path(levels: Sequence[str]) -> Column:
    return F.concat_ws("/", *levels) if levels else F.lit("")


def _share(nodes: DataFrame, level: int, levels: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """Splits each parent's ``budget`` (column ``parent_budget``) among its children."""
    parent, path = _path(levels[:level]), _path(levels[: level + 1])
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    weight = F.coalesce(F.try_element_at(table, path), F.lit(1.0)) if weights else F.lit(1.0)
    own = Window.partitionBy("parent").orderBy("ratio", "path")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("parent")
    return (
        nodes.withColumns({"parent": parent, "path": path})
        .withColumn("weight", weight.cast("double"))
        .withColumn("ratio", F.coalesce(F.try_divide(F.col("capacity").cast("double"), F.col("weight")), F.lit(float("inf"))))
        .withColumn("water", F.try_divide(F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("share", F.least(F.col("capacity").cast("double"), F.col("weight") * F.max("water").over(whole)))
        .withColumn("upto", F.floor(F.sum("share").over(upto) + 1e-6))
        .withColumn("budget", F.col("upto") - F.coalesce(F.lag("upto").over(own), F.lit(0)))
        .drop("parent", "path", "weight", "ratio", "water", "share", "upto", "parent_budget")
    )


def budgets(leaves: DataFrame, budget: Column, levels: Sequence[str] = LEVELS, weights: dict[str, float] | None = None, max_epochs: int = 1) -> DataFrame:
    """``leaves`` (a column for each level, ``tokens``) with ``budget``, whole tokens. ``weights`` has paths such as ``a`` or
    ``a/en/x``; others weigh 1. ``budget`` may refer to ``total``, the tokens that there are."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    root = leaves.agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("total")).select(F.least(F.col("capacity"), budget.cast("long")).alias("parent_budget"))
    level: DataFrame = root
    for i in range(len(levels)):
        nodes = leaves.groupBy(*levels[: i + 1]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.join(level, list(levels[:i])) if i else nodes.join(F.broadcast(level))  # one row
        level = _share(nodes, i, levels, weights or {}).drop("capacity")
        level = level if i == len(levels) - 1 else level.drop("tokens").withColumnRenamed("budget", "parent_budget")
    return level


def _order(seed: str, epoch: Column, id_col: Column, print_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("")), print_))


def plan(docs: DataFrame, budget: Column, levels: dict[str, Column], weights: dict[str, float] | None = None, max_epochs: int = 1, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a leaf: its levels, ``budget``, ``epochs`` (whole ones) and, of the next one, ``cut`` (the order key of the last
    document taken, null if none), ``cut_take`` (tokens taken of it and its equals) and ``cut_rows`` (how many they are)."""
    names = list(levels)
    thin = written(docs.select(F.col(id_col).alias("doc_id"), F.md5(text_of(text_col)).alias("print"), words(text_col).alias("tokens"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()]), "tokens")
    leaves = thin.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    shares = written(
        budgets(leaves, budget, names, weights, max_epochs)
        .withColumn("epochs", F.coalesce(F.try_divide(F.col("budget") - F.expr("budget % tokens"), F.col("tokens")), F.lit(0)).cast("int"))
        .withColumn("rest", F.expr("budget % tokens"))
        .drop("tokens"),
        "shares",
    )
    n = thin.count()
    digits = max(2, math.ceil(math.log(max(1, n / 4096), 16)))
    keyed = thin.join(small(shares.where("rest > 0")), names).withColumn("cut", _order(seed, F.col("epochs"), F.col("doc_id"), F.col("print"))).withColumn("bin", F.substring("cut", 1, digits))
    bins = keyed.groupBy(*names, "rest", "bin").agg(F.sum("tokens").alias("in_bin"))
    before = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(before), F.lit(0))).where("before < rest and rest <= before + in_bin").select(*names, "bin", "before")
    inside = Window.partitionBy(*names).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        keyed.join(small(cuts), [*names, "bin"])
        .groupBy(*names, "rest", "before", "cut")
        .agg(F.sum("tokens").alias("in_cut"), F.count(F.lit(1)).alias("cut_rows"))
        .withColumn("before", F.col("before") + F.coalesce(F.sum("in_cut").over(inside), F.lit(0)))
        .where("before < rest and rest <= before + in_cut")
        .select(*names, "cut", "cut_rows", (F.col("rest") - F.col("before")).alias("cut_take"))
    )
    return written(shares.drop("rest").join(ends, names, "left"), "cuts")


def small(leaves: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, which are counted, are few enough."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def mix(docs: DataFrame, budget: Column, levels: dict[str, Column], weights: dict[str, float] | None = None, max_epochs: int = 1, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each time that a document is taken and ``mix_epoch, mix_tokens, mix_take, mix_budget`` and the levels as
    ``mix_<level>``. ``mix_take`` is below ``mix_tokens`` only for the last document of a leaf.

    Null levels are the empty name; a null or empty text is one token; rows equal in id and text are taken one after another, so a leaf's takes
    never exceed its budget. An empty table gives no rows. Columns of ``docs`` keep names and values; an added column whose name is taken gets underscores
    at its end.
    """
    cuts = plan(docs, budget, levels, weights, max_epochs, seed, id_col, text_col)
    ties = cuts.where("cut_rows > 1").limit(1).count() > 0
    cuts = cuts.drop("cut_rows").withColumnsRenamed({c: f"mix_{c}" for c in cuts.columns})
    names = [f"mix_{n}" for n in levels]
    # the documents' own columns are numbered, so that none has a name that is added
    leveled = docs.select(
        *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)],
        *[F.coalesce(c.cast("string"), F.lit("")).alias(f"mix_{n}") for n, c in levels.items()],
        words(text_col).alias("mix_tokens"),
        F.col(id_col).alias("id"),
        F.md5(text_of(text_col)).alias("print"),
    )
    placed = leveled.join(small(cuts), names).withColumn("mix_key", _order(seed, F.col("mix_epochs"), F.col("id"), F.col("print"))).drop("id", "print")
    at_cut = F.coalesce(F.col("mix_key") == F.col("mix_cut"), F.lit(False))
    below = F.when(F.col("mix_key") < F.col("mix_cut"), F.col("mix_tokens"))
    if ties:
        met = placed.where(~at_cut).withColumn("mix_last", below).unionByName(_shared(placed.where(at_cut), names))
    else:
        met = placed.withColumn("mix_last", F.when(at_cut, F.col("mix_cut_take")).otherwise(below))
    takes = F.filter(
        F.concat(
            F.when(F.col("mix_epochs") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("mix_epochs") - 1, F.lit(0))), lambda e: F.struct(e.alias("epoch"), F.col("mix_tokens").alias("take")))).otherwise(F.array().cast("array<struct<epoch:int,take:bigint>>")),
            F.array(F.struct(F.col("mix_epochs").alias("epoch"), F.col("mix_last").alias("take"))),
        ),
        lambda t: t["take"].isNotNull(),
    )
    taken = met.withColumn("mix_taken", F.explode(takes)).withColumns({"mix_epoch": F.col("mix_taken.epoch"), "mix_take": F.col("mix_taken.take")})
    added = [*names, "mix_tokens", "mix_budget", "mix_epoch", "mix_take"]
    own = [F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return taken.select(*own, *[F.col(c).alias(_free(c, docs.columns)) for c in added])


def _free(name: str, taken: Sequence[str]) -> str:
    return name if name not in taken else _free(name + "_", taken)


def _shared(edge: DataFrame, names: Sequence[str]) -> DataFrame:
    """``edge``, the rows equal to the last document of their leaf, with ``mix_last``: ``mix_cut_take`` dealt to them in turn. They are numbered by
    the task that read them and their place in it, so equal rows of any number are numbered by many tasks."""
    rows = written(edge.withColumn("mix_row", F.monotonically_increasing_id()).withColumn("mix_part", F.shiftright("mix_row", 33)), "edge")
    before = Window.partitionBy(*names).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*names, "mix_part").agg(F.count(F.lit(1)).alias("n")).select(*names, "mix_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_base"))
    own = Window.partitionBy(*names, "mix_part").orderBy("mix_row")
    numbered = rows.withColumn("mix_nth", F.row_number().over(own)).join(small(bases), [*names, "mix_part"])
    left = F.col("mix_cut_take") - (F.col("mix_base") + F.col("mix_nth") - 1) * F.col("mix_tokens")
    return numbered.withColumn("mix_last", F.when(left > 0, F.least(left, F.col("mix_tokens")))).drop("mix_row", "mix_part", "mix_base", "mix_nth")


def document_levels() -> dict[str, Column]:
    """Domain (the first digit of the MD5 of the source, by four: ``documents`` has no domain), language, source."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return {"domain": F.concat(F.lit("d"), F.translate(F.substring(F.md5(source), 1, 1), "0123456789abcdef", "0123012301230123")), "lang": F.col("lang"), "source": F.col("source")}


DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the corpus's tokens, domains at 4:3:2:1, languages and sources alike, at most two epochs."""
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), F.expr("total div 2"), document_levels(), DOMAIN_WEIGHTS, max_epochs=2)
    return mixed.select("doc_id", F.col("mix_epoch").cast("long").alias("epoch"), F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_take").alias("take_tokens"), F.col("mix_budget").alias("leaf_budget"))


def _sql_level(i: int, levels: tuple[str, ...] = LEVELS) -> str:
    own, up = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
    part = f"PARTITION BY {up}" if i else ""
    weight = "CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END" if i == 0 else "1.0"
    join = f"JOIN b{i - 1} USING ({up})" if i else "CROSS JOIN root"
    return f"""
n{i} AS (SELECT {own}, sum(capacity) AS capacity, any_value(pb) AS pb, ({weight})::DOUBLE AS w FROM (SELECT {own}, capacity, pb FROM leaves {join}) GROUP BY {own}),
r{i} AS (SELECT *, capacity / w AS ratio FROM n{i}),
f{i} AS (SELECT *, (pb - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER ({part}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS water
   FROM r{i} WINDOW o AS ({part} ORDER BY ratio, concat_ws('/', {own}))),
s{i} AS (SELECT *, least(capacity::DOUBLE, w * max(water) OVER ({part})) AS share FROM f{i}),
u{i} AS (SELECT *, floor(sum(share) OVER ({part} ORDER BY ratio, concat_ws('/', {own}) ROWS UNBOUNDED PRECEDING) + 1e-6)::BIGINT AS upto FROM s{i}),
b{i} AS (SELECT {own}, upto - coalesce(lag(upto) OVER ({part} ORDER BY ratio, concat_ws('/', {own})), 0) AS pb FROM u{i}),"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_mixing": op7_mixing}
SQL = {
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, 'd' || translate(md5(coalesce(source, ''))[1], '0123456789abcdef', '0123012301230123') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS tokens, md5(coalesce(text, '')) AS print FROM documents),
leaves AS (SELECT domain, lang, source, (2 * sum(tokens))::BIGINT AS capacity FROM d GROUP BY ALL),
root AS (SELECT least(sum(capacity), sum(capacity) // 2 // 2)::BIGINT AS pb FROM leaves),"""
    + "".join(_sql_level(i) for i in range(3))
    + """
e AS (SELECT d.*, b2.pb AS leaf_budget, unnest([0, 1]) AS epoch FROM d JOIN b2 USING (domain, lang, source)),
k AS (SELECT *, md5(concat_ws('|', 'mix', epoch, coalesce(doc_id::VARCHAR, ''), print)) AS u FROM e),
c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, epoch::BIGINT AS epoch, domain, lang, source, tokens, least(tokens, leaf_budget - before)::BIGINT AS take_tokens, leaf_budget::BIGINT AS leaf_budget FROM c WHERE before < leaf_budget
"""
}
