"""Prompts, completions by a function of the user's, and what is read from responses."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarryline.functions.text import SPACE, strip

#: Prompts that a task asks about before it gives their answers on.
PROMPTS = 256
_FENCE = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.DOTALL)


def first_object(text: str | None) -> str | None:
    """The first JSON object: in a fence if there is one, else the first balanced braces outside strings; null if it doesn't parse."""
    if not text:
        return None
    fenced = _FENCE.search(text)
    if fenced:
        found = fenced[1]
    else:
        start = text.find("{")
        if start < 0:
            return None
        try:
            _, end = json.JSONDecoder().raw_decode(text, start)
        except ValueError:
            return None
        found = text[start:end]
    try:
        return found if isinstance(json.loads(found), dict) else None
    except ValueError:
        return None


def extract_json(response: Column) -> Column:
    """The first JSON object of each response, as text."""

    @F.pandas_udf(StringType())
    def run(responses: pd.Series) -> pd.Series:
        return responses.map(first_object)

    return run(response)


def render(template: str, **columns: Column) -> Column:
    """The template with ``{name}`` replaced by columns, nulls by nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def shortened(text: Column, most: int, mark: str = "") -> Column:
    """The first ``most`` characters, with ``mark`` where something is cut; nothing for null."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def prompts(rows: DataFrame, templates: dict[str, str], limits: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """Adds a column for each of ``templates`` (name and text), of the columns that it names; those in ``limits`` (most characters, mark of a cut) are shortened."""
    limits = limits or {}
    out = rows
    for name, template in templates.items():
        used = {c for c in re.findall(r"\{(\w+)\}", template)}
        out = out.withColumn(name, render(template, **{c: shortened(F.col(c).cast("string"), *limits[c]) if c in limits else F.col(c) for c in used}))
    return out


def complete(rows: DataFrame, make: Callable[[], Callable[[str], str]], prompt: str = "prompt", retries: int = 2, parse: Callable[[str], str | None] | None = None) -> DataFrame:
    """Adds ``response, error, attempts``: ``make`` gives the completion function once in each task; a call that fails is tried ``retries`` times more. With ``parse`` an answer of which
    it makes nothing has failed too, and what it makes of the last good one is added as ``found``; the last answer stays in ``response``."""
    kept = rows.columns
    added = ["response", "error", "attempts", *(["found"] if parse else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make()

        def one(text: str) -> tuple:
            response = error = None
            for n in range(1, retries + 2):
                try:
                    response = ask(text)
                    found = parse(response) if parse else None
                    if parse is None or found is not None:
                        return response, None, n, found
                    error = "no JSON object in the answer"
                except Exception as x:  # noqa: BLE001  what a user's function raises goes to the row
                    error = f"{type(x).__name__}: {x}"
            return response, error, retries + 1, None

        for batch in batches:
            # prompts are long: a few are in Python at once, and rows go back as they came
            for lo in range(0, batch.num_rows, PROMPTS):
                part = batch.slice(lo, PROMPTS)
                answers = [one(t) for t in part.column(prompt).to_pylist()]
                columns = [pa.array([a[i] for a in answers], pa.int32() if name == "attempts" else pa.string()) for i, name in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *columns], [*kept, *added])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, response string, error string, attempts int" + (", found string" if parse else ""))


def complete_json(rows: DataFrame, make: Callable[[], Callable[[str], str]], prompt: str = "prompt", retries: int = 2) -> DataFrame:
    """``complete`` with ``found``, the first JSON object of the answer; an answer without one is asked for again."""
    return complete(rows, make, prompt, retries, first_object)


def clean_rewrite(response: Column, question: Column) -> Column:
    """The first line of a rewritten question; the question if it is blank or there is no answer."""
    first = strip(F.get(F.split(strip(response), "\n"), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), question)


def clean_keyword(response: Column, question: Column) -> Column:
    """The first line without its label (a fixed value); the question if nothing is left."""
    first = strip(F.get(F.split(strip(response), "\n"), F.lit(0)))
    bare = strip(F.regexp_replace(first, f"^关键词(?:[：:]|{SPACE})*", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), question)


def context(numbered: Column, model: Column, page: Column, section: Column, text: Column) -> Column:
    """A chunk's entry in a prompt: a numbered header of what is known of it, then its text."""
    known = F.array_join(F.filter(F.array(model, F.when(page.isNotNull(), F.concat(F.lit("P."), page.cast("string"))), section), lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    return F.concat(F.lit("["), numbered.cast("string"), F.lit("] "), known, F.lit("\n"), text)
