"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are the spans of the base patterns and of looser ones. Three labelers vote for, against or not at all on each: the pattern (strict form
and checks), a gazetteer (top-level domains, calling codes, card prefixes, address blocks) and the context (cue words before the span).
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, and the posteriors train a logistic span
classifier on votes and shape. Base spans stay whatever it says; of the looser candidates those that it accepts are added.

Texts are scanned once, by regular expressions without unbounded backtracking; the work on the spans of one text grows as their number (running sums are
taken in blocks, overlaps found by halving). The counts of (kind, votes, shape) are at most a few hundred rows whatever the input, and they alone reach the
driver. What is written on the way holds places and votes, no personal data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import documents, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive repeats where giving back can't help; a match may begin where the last one ended. Runs of digits too short for a card are passed over.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to have a match.
FIRST = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: Looser candidates: spelled-out addresses, numbers without a country code, IPv6 addresses. Cards that fail the check digit come with the base pattern.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+().-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
LOOSE_FIRST = {
    "email": lambda t: t.rlike(r"[\[(]at[\])]|\x20dot\x20|[\[(]dot[\])]"),
    "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    "phone": lambda t: t.rlike(r"[0-9]\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3}"),
}
#: The gazetteers, as prefix or suffix patterns of a span.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]?\x20?)(?:com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|uk|it|nl|eu|ch|at|us|ca|au|jp|cn|ru|br|in|pl|se)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|30[0-5]|36|38)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
#: Cue words for a kind, and words that speak against any.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|adresse)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|addr|login|adresse|direcci)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|ring|t[eé]l|tel[eé]fono|handy)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|section|figure|table|chapter|page|order|invoice|serial|build|release)\W*$"
#: Characters of context before a span, and matches before it that may be part of them: the shortest match, a phone, has four characters.
LEFT, BEHIND = 40, 10
LABELERS = ("pattern", "gazetteer", "context")
#: Elements of an array that are folded one after another; blocks of so many are folded apart.
BLOCK = 64

PAIRS = "array<struct<gap:int,tail:string,hit:string>>"


def with_running(rows: DataFrame, arrays: list[str], value: Callable[[Column], Column], zero: Column, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``<array>_run`` for each of ``arrays``: for each element the fold of the values of all up to it. A block's elements are folded from its first,
    blocks from the first of all, so that n elements take some n * BLOCK / 2 + (n / BLOCK) ** 2 / 2 steps."""
    fold = lambda xs, f: F.aggregate(xs, zero, lambda acc, x: join(acc, f(x)))
    none = F.filter(F.array(F.lit(0)), lambda _: F.lit(False))

    def blocks(c: str) -> Column:
        firsts = F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c), F.lit(BLOCK))).otherwise(none)
        return F.transform(firsts, lambda i: F.slice(c, i, F.lit(BLOCK)))

    def bases(c: str) -> Column:
        return F.transform(f"{c}_sums", lambda _, i: F.aggregate(F.slice(f"{c}_sums", 1, i), zero, join))

    def run(c: str) -> Column:
        return F.flatten(F.zip_with(f"{c}_blocks", f"{c}_bases", lambda xs, base: F.transform(xs, lambda _, i: join(base, fold(F.slice(xs, F.lit(1), i + 1), value)))))

    # each array is a column of its own that is read twice, so that no lambda computes it anew
    rows = rows.withColumns({f"{c}_blocks": blocks(c) for c in arrays})
    rows = rows.withColumns({f"{c}_sums": F.transform(f"{c}_blocks", lambda xs: fold(xs, value)) for c in arrays})
    rows = rows.withColumns({f"{c}_bases": bases(c) for c in arrays})
    return rows.withColumns({f"{c}_run": run(c) for c in arrays}).drop(*[f"{c}_{x}" for c in arrays for x in ("blocks", "sums", "bases")])


def matches(text: Column, pattern: str, first: Column) -> Column:
    """All leftmost non-overlapping matches, each with the length and the end of the text between it and the one before: what splitting leaves."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda h, g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(LEFT)).alias("tail"), h.alias("hit")))
    return F.when(first, F.filter(pairs, lambda p: p["hit"].isNotNull())).otherwise(F.expr(f"cast(array() AS {PAIRS})"))


def with_spans(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns from ``matches`` as start and end (code points, exclusive), value and the ``LEFT`` characters before."""

    def before(c: str) -> Column:
        behind = lambda i: F.array_join(F.transform(F.slice(c, F.greatest(i - BEHIND, F.lit(0)) + 1, F.least(i, F.lit(BEHIND))), lambda p: F.concat(p["tail"], p["hit"])), "")
        return F.transform(c, lambda p, i: F.when(F.length(p["tail"]) >= LEFT, p["tail"]).otherwise(F.right(F.concat(behind(i), p["tail"]), F.lit(LEFT))))

    def placed(c: str) -> Column:
        ends = F.arrays_zip(F.col(f"{c}_run").alias("end"), F.col(f"{c}_before").alias("before"))
        return F.zip_with(c, ends, lambda p, at: F.struct((at["end"] - F.length(p["hit"])).alias("start"), at["end"].alias("end"), p["hit"].alias("value"), at["before"].alias("before")))

    rows = with_running(rows, names, lambda p: p["gap"] + F.length(p["hit"]), F.lit(0), lambda a, b: a + b).withColumns({f"{c}_before": before(c) for c in names})
    return rows.withColumns({c: placed(c) for c in names}).drop(*[f"{c}_{x}" for c in names for x in ("run", "before")])


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    step = lambda s, i: s + F.when(i % 2 == 1, F.substring(digits, n - i + 1, F.lit(1)).cast("int")).otherwise(F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), F.substring(digits, n - i + 1, F.lit(1)).cast("int") + 1))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def checked(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern passes the kind's test."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: all candidates of each text, with ``base``: whether a base pattern found it and it passed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    t = F.col("text")
    rows = rows.select("doc_id", *[matches(t, BASE[k], FIRST[k](t)).alias(f"base_{k}") for k in KINDS], *[matches(t, LOOSE[k], LOOSE_FIRST[k](t)).alias(f"loose_{k}") for k in LOOSE])
    rows = with_spans(rows, rows.columns[1:])

    def shaped(kind: str, base: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before"), base(s["value"]).alias("base"))

    def passed(kind: str) -> Callable[[Column], Column]:
        return lambda value: checked(kind, value)

    arrays = [F.transform(f"base_{k}", shaped(k, passed(k))) for k in KINDS]
    arrays = [F.filter(a, lambda s: s["base"] | ((s["kind"] == "card") & _digits(s["value"]).between(13, 19))) for a in arrays]
    loose = [F.transform(f"loose_{k}", shaped(k, lambda _: F.lit(False))) for k in LOOSE]
    arrays += [F.filter(a, lambda s: (s["kind"] != "phone") | _digits(s["value"]).between(9, 15)) for a in loose]
    return rows.select("doc_id", F.concat(*arrays).alias("found"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def features(s: Column) -> Column:
    """``kind:pattern vote:gazetteer vote:context vote:length bucket:digits bucket`` of a candidate, the last two 0 to 2."""
    kind, value, before = s["kind"], s["value"], s["before"]

    def by(table: dict[str, str], of: Column) -> Column:
        out = F.lit(False)
        for k, p in table.items():
            out = F.when(kind == k, of.rlike(p)).otherwise(out)
        return out

    loose = F.coalesce(F.when(kind == "card", ~s["base"]), F.lit(False))
    pattern = _vote(s["base"], loose)
    listed = by(GAZETTEER, F.regexp_replace(value, r"^[\x20]+", ""))
    gazetteer = _vote(listed, F.lit(True))
    context = _vote(by(CUES, before), before.rlike(AGAINST))
    n, d = F.length(value), _digits(value)
    size = F.when(n < 12, 0).when(n < 20, 1).otherwise(2)
    share = F.when(2 * d < n, 0).when(10 * d < 9 * n, 1).otherwise(2)
    return F.concat_ws(":", kind, *[c.cast("string") for c in (pattern, gazetteer, context, size, share)])


Key = tuple[str, int, int, int, int, int]


def parsed(key: str) -> Key:
    kind, *rest = key.split(":")
    return (kind, *map(int, rest))


def reliabilities(counts: dict[Key, int], rounds: int = 50) -> tuple[dict[str, float], list[dict[int, tuple[float, float]]], dict[Key, float]]:
    """Expectation-maximisation: the share of true spans of each kind, each labeler's chance of each vote on (false, true) spans, and the
    posterior of each key. Votes are taken as independent given the truth; one pseudo-count for the expected vote steadies small tables."""
    share = dict.fromkeys(KINDS, 0.5)
    chance = [{1: (0.2, 0.6), 0: (0.4, 0.3), -1: (0.4, 0.1)} for _ in LABELERS]
    posterior: dict[Key, float] = {}
    for _ in range(rounds):
        for key in counts:
            yes, no = share[key[0]], 1 - share[key[0]]
            for j, v in enumerate(key[1:4]):
                no, yes = no * chance[j][v][0], yes * chance[j][v][1]
            posterior[key] = yes / (yes + no)
        for k in KINDS:
            n = sum(c for key, c in counts.items() if key[0] == k)
            share[k] = (1 + sum(c * posterior[key] for key, c in counts.items() if key[0] == k)) / (2 + n)
        for j in range(len(LABELERS)):
            prior = {1: (0.2, 0.6), 0: (0.4, 0.3), -1: (0.4, 0.1)}
            sums = {v: [5 * prior[v][0], 5 * prior[v][1]] for v in prior}
            for key, c in counts.items():
                sums[key[1 + j]][0] += c * (1 - posterior[key])
                sums[key[1 + j]][1] += c * posterior[key]
            total = [sum(s[y] for s in sums.values()) for y in (0, 1)]
            chance[j] = {v: (s[0] / total[0], s[1] / total[1]) for v, s in sums.items()}
    return share, chance, posterior


def classifier(counts: dict[Key, int], posterior: dict[Key, float], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> dict[Key, float]:
    """Logistic regression on votes, kind and shape, with the posteriors as soft labels: the chance of each key."""

    def parts(key: Key) -> list[tuple]:
        kind, *votes, size, share = key
        return [("bias",), ("kind", kind), ("size", kind, size), ("share", kind, share), *[("vote", j, v) for j, v in enumerate(votes)]]

    weights: dict[tuple, float] = {}
    seen: dict[tuple, float] = {}
    total = sum(counts.values()) or 1
    chance = lambda key: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(p, 0.0) for p in parts(key))))))
    for _ in range(rounds):
        step: dict[tuple, float] = {}
        for key, c in counts.items():
            error = (posterior[key] - chance(key)) * c / total
            for p in parts(key):
                step[p] = step.get(p, 0.0) + error
        for p, g in step.items():
            g -= decay * weights.get(p, 0.0)
            seen[p] = seen.get(p, 1e-8) + g * g
            weights[p] = weights.get(p, 0.0) + rate * g / math.sqrt(seen[p])
    return {key: chance(key) for key in counts}


def _meets(span: Column, spans: str, tops: str, top: Callable[[Column], Column]) -> Column:
    """Whether a span overlaps one of ``spans`` (by start), the greatest end of all up to each being in ``tops``: by halving."""
    steps = F.lit([2**i for i in range(30, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= F.size(spans)) & (F.try_element_at(spans, n + k)["start"] < span["end"]), n + k).otherwise(n))
    return F.coalesce(top(F.try_element_at(tops, F.nullif(F.least(at, F.size(tops)), F.lit(0)))) > span["start"], F.lit(False))


def without_overlaps(rows: DataFrame) -> DataFrame:
    """``found`` without added spans that meet a base one, or an added one of an earlier kind that meets no base one; by kind, then start."""
    rank = lambda s: F.array_position(F.lit(list(KINDS)), s["kind"])
    added = F.filter("found", lambda s: ~s["base"])
    by_start = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rank(s).alias("rank"), s.alias("span"))))
    none = F.filter("found", lambda _: F.lit(False))
    rows = rows.select("doc_id", "found", added.alias("added")).withColumn("base", by_start(F.when(F.size("added") > 0, F.filter("found", lambda s: s["base"])).otherwise(none)))
    rows = with_running(rows, ["base"], lambda b: b["end"], F.lit(0), lambda a, b: F.greatest(a, b))
    rows = rows.withColumn("free", by_start(F.filter("added", lambda s: ~_meets(s, "base", "base_run", lambda top: top))))
    # the greatest end of spans of the first kind, of the first two, of the first three
    firsts = range(1, len(KINDS))
    ends = lambda f: F.array(*[F.when(f["rank"] <= k, f["end"]).otherwise(0) for k in firsts])
    zero = F.array(*[F.lit(0) for _ in firsts])
    rows = with_running(rows, ["free"], ends, zero, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    alone = F.filter("free", lambda s: (s["rank"] == 1) | ~_meets(s, "free", "free_run", lambda top: F.try_element_at(top, F.nullif(s["rank"].cast("int") - 1, F.lit(0)))))
    all_ = F.concat(F.filter("found", lambda s: s["base"]), F.transform(alone, lambda s: s["span"]))
    ordered = F.transform(F.array_sort(F.transform(all_, lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s.alias("span")))), lambda s: s["span"])
    return rows.select("doc_id", F.when(F.size("found") > 1, ordered).otherwise(F.col("found")).alias("found"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row a document: ``doc_id, found``, all spans (kind, start, end, base, chance) by kind as in ``KINDS``, then start.

    Added spans meet no base span, nor an added one of an earlier kind. Null text counts as empty; repeated rows are searched each; an empty table
    gives no rows; other columns are not read.
    """
    places = lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base")], features(s).alias("key"))
    rows = written(candidates(docs, id_col, text_col).withColumn("found", F.transform("found", places)), "candidates")
    seen = rows.where("size(found) > 0").select(F.explode("found.key").alias("key")).groupBy("key").count().collect()
    counts = {parsed(r["key"]): r["count"] for r in seen}
    _, _, posterior = reliabilities(counts)
    scores = {":".join(map(str, k)): v for k, v in classifier(counts, posterior).items()}
    table = F.create_map(*[F.lit(x) for kv in sorted(scores.items()) for x in kv]) if scores else F.expr("cast(map() AS map<string,double>)")
    chanced = F.transform("found", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base")], F.coalesce(F.try_element_at(table, s["key"]), F.lit(0.0)).alias("chance")))
    return without_overlaps(rows.select("doc_id", F.filter(chanced, lambda s: s["base"] | (s["chance"] >= least)).alias("found")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data(documents(spark, sf_dir))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown("found").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pii": op1_pii}
#: Expectation-maximisation can't be expressed in SQL; the query is tested against plain patterns.
SQL: dict[str, str] = {}
