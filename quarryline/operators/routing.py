"""Which models a question is about."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import routing_key


def file_models(files: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their model, files of no registered model). ``models``: ``model_id, name, file``."""
    return files.join(models.select("file", "model_id"), "file"), files.join(models.select("file"), "file", "left_anti")


def display_names(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``display``: the model's name, else its id."""
    return rows.join(models.select("model_id", "name"), "model_id", "left").withColumn("display", F.coalesce("name", "model_id")).drop("name")


#: Registries of more names than this are routed by one automaton, which reads a text once; fewer are tried one by one in columns.
FEW_NAMES = 64


def _by_length(aliases: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Each (model, alias without white space, in lower case) once: the longest first, then in the order of the registry."""
    first = {(m, "".join(a.split()).lower()): i for i, (m, a) in reversed(list(enumerate(aliases))) if a.strip()}
    return [x for x, _ in sorted(first.items(), key=lambda kv: (-len(kv[0][1]), kv[1]))]


def route(question: Column, rewritten: Column, aliases: list[tuple[str, str]]) -> Column:
    """The models whose alias the text holds, by longest alias first; what an alias has taken no later one can. ``aliases``: (model, alias) in the order of the
    registry, which decides among aliases of one length."""
    hay = routing_key(F.concat(F.coalesce(question, F.lit("")), F.lit(" "), F.coalesce(rewritten, F.lit(""))))
    ordered = _by_length(aliases)
    if not ordered:
        return F.array().cast("array<string>")
    if len(ordered) > FEW_NAMES:
        return _by_automaton(hay, ordered)
    table = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("alias")) for m, a in ordered])
    start = F.struct(hay.alias("hay"), F.array().cast("array<string>").alias("found"))

    def take(acc: Column, x: Column) -> Column:
        at = F.instr(acc["hay"], x["alias"])
        new = (at > 0) & ~F.array_contains(acc["found"], x["model"])
        masked = F.overlay(acc["hay"], F.repeat(F.lit("\0"), F.length(x["alias"])), at, F.length(x["alias"]))
        return F.struct(F.when(new, masked).otherwise(acc["hay"]).alias("hay"), F.when(new, F.array_append(acc["found"], x["model"])).otherwise(acc["found"]).alias("found"))

    return F.aggregate(table, start, take)["found"]


@lru_cache(4)
def _automaton(ordered: tuple[tuple[str, str], ...]):  # noqa: ANN202
    import ahocorasick

    models: dict[str, list[int]] = {}
    for i, (_, alias) in enumerate(ordered):
        models.setdefault(alias, []).append(i)
    found = ahocorasick.Automaton()
    for alias, places in models.items():
        found.add_word(alias, (len(alias), tuple(places)))
    found.make_automaton()
    return found


def models_in(hay: str, ordered: tuple[tuple[str, str], ...]) -> list[str]:
    """One pass over the text gives all places of all names; then names are taken from the longest on, each at its first place that meets nothing taken."""
    places: dict[int, list[tuple[int, int]]] = {}
    for end, (n, names) in _automaton(ordered).iter(hay):
        for i in names:
            places.setdefault(i, []).append((end + 1 - n, end + 1))
    starts: list[int] = []  # of what is taken, ascending, and where it ends
    ends: list[int] = []
    found: dict[str, None] = {}
    for i in sorted(places):
        model = ordered[i][0]
        if model in found:
            continue
        for a, b in places[i]:
            k = bisect_left(starts, b)
            if not k or ends[k - 1] <= a:
                starts.insert(k, a)
                ends.insert(k, b)
                found[model] = None
                break
    return list(found)


def _by_automaton(hay: Column, ordered: list[tuple[str, str]]) -> Column:
    names = tuple(ordered)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: models_in(t or "", names))

    return run(hay)


def sticky(turns: DataFrame, found: str = "found", session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Adds ``active`` (the models found, else the session's last ones) and ``needs_clarification`` (neither)."""
    before = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    some = F.when(F.size(found) > 0, F.col(found))
    rows = turns.withColumn("active", F.coalesce(some, F.last(some, ignorenulls=True).over(before)))
    return rows.withColumn("needs_clarification", F.col("active").isNull())
