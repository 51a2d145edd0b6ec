"""Quality rules for generated answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import SPACE, strip
from quarryline.operators.routing import route

#: Phrases that give away the source, removed in this order.
LEAKS = [r"根据手册[，,]?", r"根据(上述|以上|资料|内容)[，,]?", r"作为(一个)?\s*AI[^，。,.\n]*[，,]?", r"作为(智能)?助手[，,]?", r"参考第?\s*\p{Nd}+\s*页", r"见第?\s*\p{Nd}+\s*(章|节|页)", r"\[\p{Nd}+\]"]
#: Units, longer ones first.
UNITS = ["kWh", "kW", "km/h", "km", "kPa", "MPa", "bar", "V", "A", "Nm", "N·m", "℃", "°C", "%", "升", "L", "公里", "千米", "巴", "伏", "安", "牛·米", "分钟", "小时", "秒"]
#: Promises, terms of insurance, dangers, and words that answer a danger.
OVER_PROMISES = ["免费", "一定", "永久", "保证", "保险全赔", "绝对", "100%"]
INSURANCE = ["保险", "质保", "三包"]
DANGERS = ["高压", "动力电池", "电池起火", "救援", "拖车", "起火", "触电"]
GUARDS = ["授权", "服务中心", "专业人员", "售后", "客服", "维修站"]


def number_pattern(units: list[str] | None = None) -> str:
    return r"(?i)\p{Nd}+(?:\.\p{Nd}+)?" + SPACE + "*(?:" + "|".join(UNITS if units is None else units) + ")"


def strip_leaks(text: Column, patterns: list[str] | None = None) -> Column:
    for p in LEAKS if patterns is None else patterns:
        text = F.regexp_replace(text, p.replace(r"\s", SPACE), "")
    return strip(text)


def ungrounded_numbers(output: Column, evidence: Column, units: list[str] | None = None) -> Column:
    """Numbers with units in the output of which the evidence holds neither the whole nor the number. A number that lies inside a longer one counts as
    held. White space of any kind is left out of both before they are compared, so that a line break between number and unit doesn't part them."""
    tight = F.regexp_replace(evidence, SPACE, "")
    found = F.transform(F.regexp_extract_all(output, F.lit(number_pattern(units)), F.lit(0)), lambda m: F.regexp_replace(m, SPACE, ""))
    return F.filter(found, lambda m: ~F.contains(tight, m) & ~F.contains(tight, F.regexp_extract(m, r"^\p{Nd}+(?:\.\p{Nd}+)?", 0)))


def absent_words(output: Column, evidence: Column, words: list[str]) -> Column:
    """The words that the output has and the evidence hasn't."""
    return F.filter(F.lit(words), lambda w: F.contains(output, w) & ~F.contains(evidence, w))


def unguarded(output: Column, dangers: list[str] | None = None, guards: list[str] | None = None) -> Column:
    has = lambda ws: F.exists(F.lit(ws), lambda w: F.contains(output, w))
    return has(DANGERS if dangers is None else dangers) & ~has(GUARDS if guards is None else guards)


def failure(
    instruction: Column,
    output: Column,
    evidence: Column,
    foreign: Column,
    max_chars: Column,
    promises: list[str] | None = None,
    insurance: list[str] | None = None,
    dangers: list[str] | None = None,
    guards: list[str] | None = None,
    units: list[str] | None = None,
    question: Column | None = None,
) -> Column:
    """``struct<reason, detail>`` of the first rule that a cleaned output fails, null if it fails none; the detail lists what was found. ``foreign``: other models that question or
    output name. A blank question, if one is given, is as bad as a blank instruction or output."""
    numbers = ungrounded_numbers(output, evidence, units)
    promised = absent_words(output, evidence, OVER_PROMISES if promises is None else promises)
    blank = (F.coalesce(strip(instruction), F.lit("")) == "") | (F.coalesce(output, F.lit("")) == "")
    if question is not None:
        blank = blank | (F.coalesce(strip(question), F.lit("")) == "")

    def found(reason: str, detail: Column | None = None) -> Column:
        return F.struct(F.lit(reason).alias("reason"), (F.lit("") if detail is None else detail).alias("detail"))

    def listed(name: str, values: Column) -> Column:
        return F.concat(F.lit(f"{name}=['"), F.array_join(values, "', '"), F.lit("']"))

    return (
        F.when(F.size(foreign) > 0, found("vehicle_conflict", listed("foreign", foreign)))
        .when(F.size(numbers) > 0, found("ungrounded_number", listed("nums", numbers)))
        .when(F.size(absent_words(output, evidence, INSURANCE if insurance is None else insurance)) > 0, found("insurance_warranty_mix"))
        .when(unguarded(output, dangers, guards), found("unsafe_danger_advice"))
        .when(F.size(promised) > 0, found("over_promise", listed("words", promised)))
        .when(blank, found("field_incomplete"))
        .when(F.length(output) > max_chars, found("length_out_of_bounds", F.concat(F.lit("len="), F.length(output).cast("string"))))
    )


def first_failure(*columns: Column, **options) -> Column:  # noqa: ANN003
    """The name alone of what ``failure`` finds."""
    return failure(*columns, **options)["reason"]


def foreign_models(instruction: Column, output: Column, model: Column, aliases: list[tuple[str, str]]) -> Column:
    """The other models that a question or its cleaned output names, those of the question first."""
    named = [F.filter(route(c, F.lit(None).cast("string"), aliases), lambda m: m != model) for c in (instruction, output)]
    return F.concat(*named)
