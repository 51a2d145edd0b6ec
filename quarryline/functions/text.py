"""String functions that every job shares, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode sees it; Java's own class is ASCII only. The same class reads alike in other regular-expression dialects.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The characters of that class.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Without white space at both ends; what lies between isn't looked at, as it would be by a regular expression."""
    return F.btrim(c, F.lit(SPACES))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores; a run of ideographs is one token."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def routing_key(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(c, SPACE, ""))


def question_key(c: Column) -> Column:
    """The routing key with full-width punctuation made narrow: equal for questions that differ in spacing and punctuation width alone."""
    return F.translate(routing_key(c), "？！，。：；（）", "?!,.:;()")


def query_tokens(question: Column, keyword: Column, rewritten: Column) -> Column:
    """Words of two letters or more of the question, then of its rewritten form, then the comma-separated parts of the keyword line; each once."""
    long = lambda a: F.filter(a, lambda t: F.length(t) >= 2)
    parts = F.transform(F.split(F.translate(F.coalesce(keyword, F.lit("")), "，", ","), ","), lambda p: F.lower(strip(p)))
    return F.array_distinct(F.concat(long(tokens(F.coalesce(question, F.lit("")))), long(tokens(F.coalesce(rewritten, F.lit("")))), long(parts)))


def sample_id(model: Column, chunk: Column, task: Column) -> Column:
    """``Q`` and ten hexadecimal digits, the same for the same sample in every run."""
    return F.concat(F.lit("Q"), F.substring(F.sha1(F.concat_ws("|", model, chunk, task)), 1, 10))


def preview(c: Column, n: int = 50) -> Column:
    return F.substring(F.replace(strip(c), F.lit("\n"), F.lit(" ")), 1, n)


def snippet(text: Column, needle: Column, before: int = 40, after: int = 80) -> Column:
    """What surrounds the needle's first place, case ignored, with an ellipsis where it is cut."""
    at = F.instr(F.lower(text), F.lower(needle)) - 1
    lo = F.greatest(F.lit(0), at - before)
    hi = F.least(F.length(text), at + F.length(needle) + after)
    cut = F.substring(text, lo + 1, hi - lo)
    return F.when(at < 0, F.lit(None).cast("string")).otherwise(F.concat(F.when(lo > 0, "…").otherwise(""), cut, F.when(hi < F.length(text), "…").otherwise("")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; of unit vectors, their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def shuffle_key(seed: int | str, *parts: Column) -> Column:
    """An order that looks random and is the same in every run."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)
