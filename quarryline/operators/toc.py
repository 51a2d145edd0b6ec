"""Tables of contents: paths, page ranges, matching entries to queries and chunks to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import strip
from quarryline.operators.chunking import stack_paths
from quarryline.sources.scratch import written

#: General sections, which count less unless the question names them.
GENERAL = ["重要提示", "前言", "用户指南", "车辆介绍", "目录", "免责声明"]
#: Answers that name nothing.
NOTHING = ["无", "none", "None", "没有"]


def toc_paths(toc: DataFrame, partition: str = "source_file", max_depth: int = 8) -> DataFrame:
    """Adds ``path``, titles joined by ``>``."""
    return stack_paths(toc, partition, ["ord"], "level", "title", max_depth).drop("depth")


def with_leaves(toc: DataFrame, partition: str = "source_file") -> DataFrame:
    """Adds ``is_leaf``: whether the next entry isn't deeper."""
    after = F.lead("level").over(Window.partitionBy(partition).orderBy("ord"))
    return toc.withColumn("is_leaf", F.coalesce(after <= F.col("level"), F.lit(True)))


def leaves(toc: DataFrame, partition: str = "source_file") -> DataFrame:
    """Entries whose next one isn't deeper."""
    return with_leaves(toc, partition).where("is_leaf").drop("is_leaf")


def page_ends(toc: DataFrame, max_page: Column, max_level: int, partition: str = "source_file") -> DataFrame:
    """Adds ``end_page``: the page before the next entry of the same or a higher level, not before the entry's own; ``max_page`` if none follows."""
    rest = Window.partitionBy(partition).orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    after = F.lit(None).cast("int")
    for level in range(max_level, 0, -1):
        after = F.when(F.col("level") == level, F.first(F.when(F.col("level") <= level, F.col("page")), ignorenulls=True).over(rest)).otherwise(after)
    return toc.withColumn("_after", after).withColumn("end_page", F.when(F.col("_after").isNull(), max_page).otherwise(F.greatest(F.col("page"), F.col("_after") - 1))).drop("_after")


def title_in_section(title: Column, section: Column) -> Column:
    return stripped_in_section(strip(title), section, F.split(section, ">"))


def stripped_in_section(title: Column, section: Column, parts: Column) -> Column:
    """The same for a title without white space at its ends, and the section with its parts."""
    return (title != "") & (section != "") & (F.contains(section, title) | F.exists(parts, lambda p: F.contains(p, title) | F.contains(title, p)))


#: Bins of pages that an entry's range is cut into at most.
BINS = 16


def chunks_of_entries(selected: DataFrame, chunks: DataFrame, each: int = 2, partition: str = "source_file") -> DataFrame:
    """``query_id, chunk_id, position``: for each selected entry (``query_id, position, path, title, page, end_page``) the ``each`` best chunks in its
    page range, those whose section fits the title or path first, then by page; cut first, then each chunk once.

    An entry is spread over the bins of pages that its range covers, of a width of its own, and meets the chunks of these bins alone; a chunk is in one bin of each
    width that entries have, so each pair meets once. An entry that many questions select meets the chunks once.
    """
    facts = [partition, "page", "end_page", "title", "path"]
    selected = written(selected.where("end_page >= page").select("query_id", "position", *facts).withColumn("entry", F.sha2(F.to_json(F.struct(*facts)), 256)), "selected-entries")
    width = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2((F.col("end_page") - F.col("page") + 1) / BINS)))).cast("long")
    bins = F.sequence(F.expr("page div width"), F.expr("end_page div width"))
    # texts are prepared once an entry, before they meet many chunks
    once = written(selected.drop("query_id", "position").dropDuplicates(["entry"]).withColumns({"title": strip(F.col("title")), "path": strip(F.col("path")), "width": width}), "distinct-entries")
    widths = once.select("width").distinct()  # powers of two: some dozens of rows at most
    own = chunks.where("page IS NOT NULL").select(partition, "chunk_id", "chunk_ord", F.col("page").alias("chunk_page"), "section_path").withColumn("parts", F.split("section_path", ">"))
    own = own.join(F.broadcast(widths)).withColumn("bin", F.expr("chunk_page div width"))
    met = once.withColumn("bin", F.explode(bins)).join(own, [partition, "width", "bin"]).where("chunk_page BETWEEN page AND end_page")
    fits = stripped_in_section(F.col("title"), F.col("section_path"), F.col("parts")) | stripped_in_section(F.col("path"), F.col("section_path"), F.col("parts"))
    rows = met.select("entry", "chunk_id", "chunk_page", "chunk_ord", F.when(fits, 0).otherwise(1).alias("unfit"))
    best = Window.partitionBy("entry").orderBy("unfit", "chunk_page", "chunk_ord")
    cut = rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= each).select("entry", "chunk_id", "nth")
    places = selected.select("query_id", "position", "entry").join(cut, "entry").groupBy("query_id", "chunk_id").agg(F.min(F.struct("position", "nth")).alias("place"))
    return places.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).alias("position"))


def named_paths(responses: DataFrame, entries: DataFrame, most: int = 3, partition: str = "source_file") -> DataFrame:
    """``response_id, path, position``: paths of the catalogue that a response names, longest first."""
    asked = responses.where((strip(F.col("response")) != "") & ~F.translate(strip(F.col("response")), "，", ",").isin(NOTHING))
    paths = entries.where("path <> ''").groupBy(partition, "path").agg(F.min("ord").alias("ord"))
    met = asked.join(paths, partition).where(F.contains("response", "path"))
    own = Window.partitionBy("response_id").orderBy(F.length("path").desc(), "ord")
    return met.withColumn("position", F.row_number().over(own)).where(F.col("position") <= most).select("response_id", "path", "position")


def named_numbers(response: Column, largest: Column | int, most: int = 3) -> Column:
    """Catalogue numbers in a response of digits and separators alone, or in its last such line with a valid one; each once, in order."""
    largest = largest if isinstance(largest, Column) else F.lit(largest)
    tight = lambda c: F.translate(F.replace(c, F.lit(" "), F.lit("")), "，", ",")
    pure = lambda c: c.rlike(r"^[0-9,、]+$")
    numbers = lambda c: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda d: d.try_cast("int")), lambda i: i.between(1, largest)))
    text = strip(response)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: tight(strip(x))), lambda x: pure(x) & (F.size(numbers(x)) > 0))
    empty = F.array().cast("array<int>")
    return F.when(text.isNull() | (text == "") | tight(text).isin(NOTHING), empty).when(pure(tight(text)), F.slice(numbers(tight(text)), 1, most)).when(F.size(lines) > 0, F.slice(numbers(F.element_at(lines, -1)), 1, most)).otherwise(empty)
