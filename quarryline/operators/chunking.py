"""Chunks of documents: by fixed windows, by heading hierarchy, by breaks in meaning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import SPACE, dot, strip

CHAPTER = r"^第[一二三四五六七八九十\p{Nd}]+[章节篇]"
BODY = "正文"


def fixed_windows(docs: DataFrame, size: int = 800, overlap: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, win_no, win_start, text``: windows of ``size`` characters, each with ``overlap`` more on both sides where there are; blank ones are left out."""
    if not 0 <= overlap <= size:
        raise ValueError("an overlap is at most a window")
    # cut in one pass; a window's edges are those of its neighbours, and it is made before the rows part, which would each carry the whole text
    cut = docs.select(id_col, F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("cuts"))
    edges = lambda i: F.coalesce(F.get("cuts", i), F.lit(""))
    whole = F.transform("cuts", lambda own, i: F.concat(F.right(edges(i - 1), F.lit(overlap)), own, F.left(edges(i + 1), F.lit(overlap))))
    start = F.greatest(F.lit(0), F.col("win_no") * size - overlap)
    rows = cut.select(id_col, F.posexplode(whole).alias("win_no", "whole"))
    # a filter on the result would strip each window twice
    return rows.where(F.col("whole").rlike(f"[^{SPACE[1:]}")).select(id_col, "win_no", start.alias("win_start"), strip(F.col("whole")).alias("text"))


def window_pages(windows: DataFrame, page_starts: DataFrame, lookup: str = "exact", id_col: str = "doc_id") -> DataFrame:
    """Adds ``page``. ``page_starts``: ``<id>, start, page``. ``exact``: the page that starts where the window does, else 1; ``asof``: the last one that
    starts no later."""
    if lookup == "exact":
        at = page_starts.select(id_col, F.col("start").alias("win_start"), "page")
        return windows.join(at, [id_col, "win_start"], "left").withColumn("page", F.coalesce("page", F.lit(1)))
    if lookup != "asof":
        raise ValueError(f"unknown page lookup: {lookup}")
    marks = windows.select(id_col, F.col("win_start").alias("at"), F.lit(1).alias("is_window"), F.struct("win_no", "text").alias("window"), F.lit(None).cast("int").alias("page"))
    pages = page_starts.select(id_col, F.col("start").alias("at"), F.lit(0).alias("is_window"), F.lit(None).cast(marks.schema["window"].dataType).alias("window"), F.col("page").cast("int"))
    so_far = Window.partitionBy(id_col).orderBy("at", "is_window").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(pages).withColumn("page", F.last("page", ignorenulls=True).over(so_far)).where("is_window = 1")
    return found.select(id_col, F.col("window.win_no").alias("win_no"), F.col("at").alias("win_start"), "window.text", F.coalesce("page", F.lit(1)).alias("page"))


def heading_levels(blocks: DataFrame, id_col: str = "source_file") -> DataFrame:
    """Adds ``heading_level`` (1, 2, 3 or null) from the font size over the document's median, weight, length and chapter marks. Blank blocks are left out."""
    blocks = blocks.withColumn("text", strip(F.col("text"))).where("text <> ''")
    # over the document's rows: they are shuffled once, with what follows
    blocks = blocks.withColumn("median_size", F.coalesce(F.median("font_size").over(Window.partitionBy(id_col)), F.lit(12.0)))
    size, mid, n = F.col("font_size"), F.col("median_size"), F.length("text")
    large = (size >= 1.25 * mid) | (F.col("is_bold") & (size >= 1.1 * mid))
    level = F.when(n > 80, None).when(F.col("text").rlike(CHAPTER), 1).when(large & (n <= 40), F.when(size < 1.5 * mid, 2).otherwise(1)).when(F.col("is_bold") & (n <= 30), 3)
    return blocks.withColumn("heading_level", level.cast("int")).drop("median_size")


def stack_paths(rows: DataFrame, partition: str, order: list[str], level: str, title: str, max_depth: int, path: str = "path") -> DataFrame:
    """Adds ``depth`` and ``path`` of a stack of titles in which a title of level n replaces what lies n - 1 deep or deeper.

    Closed form: with rn the row's number, depth = rn + least(0, running minimum of level - rn), as a step raises the depth by one at most; the title at
    depth p on the stack is the last one that came to depth p. A depth over ``max_depth`` raises an error.
    """
    own = Window.partitionBy(partition).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("rn", F.row_number().over(own)).withColumn("depth", F.col("rn") + F.least(F.lit(0), F.min(F.col(level) - F.col("rn")).over(so_far)))
    rows = rows.withColumn("depth", F.when(F.col("depth") <= max_depth, F.col("depth")).otherwise(F.raise_error(F.lit(f"titles lie more than {max_depth} deep"))))
    above = [F.when(F.col("depth") >= p, F.last(F.when(F.col("depth") == p, F.col(title)), ignorenulls=True).over(so_far)) for p in range(1, max_depth + 1)]
    return rows.withColumn(path, F.concat_ws(">", *above)).drop("rn")


def section_paths(blocks: DataFrame, id_col: str = "source_file") -> DataFrame:
    """Body blocks with the path of the headings above them. ``blocks`` has ``heading_level``."""
    so_far = Window.partitionBy(id_col).orderBy("page", "block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the stack of ``stack_paths`` in one pass: a body block has the depth of the last heading, as headings alone are counted
    rows = blocks.withColumn("_rn", F.count("heading_level").over(so_far)).withColumn("_depth", F.col("_rn") + F.least(F.lit(0), F.min(F.col("heading_level") - F.col("_rn")).over(so_far)))
    title = lambda p: F.when(F.col("heading_level").isNotNull() & (F.col("_depth") == p), F.col("text"))
    above = [F.when(F.col("_depth") >= p, F.last(title(p), ignorenulls=True).over(so_far)) for p in (1, 2, 3)]
    rows = rows.withColumn("section_path", F.when(F.col("_rn") == 0, BODY).otherwise(F.concat_ws(">", *above)))
    return rows.where("heading_level IS NULL").drop("heading_level", "_rn", "_depth")


class SectionPacker:
    """Greedy packing of a document's body blocks, in order, into chunks of ``least`` to ``most`` characters."""

    def __init__(self, least: int, most: int, merge_short: bool = True) -> None:
        self.least, self.most, self.merge_short = least, most, merge_short

    def groups(self, blocks: Iterable[tuple[int, str, str]]) -> Iterator[tuple[int, str, str]]:
        """(page, path, text) groups, each as soon as it ends. A short group takes in the next block whatever its path; should it then be too long, it ends and the block begins
        the next group as well."""
        now: tuple[int, str, str] | None = None
        for block in blocks:
            if now is None:
                now = block
                continue
            joined = (min(now[0], block[0]), now[1], f"{now[2]}\n{block[2]}")
            fits = block[1] == now[1] and len(joined[2]) <= self.most
            if fits or (self.merge_short and len(now[2]) < self.least):
                now = joined
                if len(joined[2]) <= self.most or fits:
                    continue
            yield now
            now = block
        if now:
            yield now

    def merge(self, blocks: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
        return list(self.groups(blocks))

    def split(self, group: tuple[int, str, str]) -> list[tuple[int, str, str]]:
        """A group over ``most`` characters, cut between lines; a longer line stays whole."""
        page, path, text = group
        if len(text) <= self.most:
            return [group]
        parts, held = [], ""
        for line in text.split("\n"):
            if held and len(held) + 1 + len(line) > self.most:
                parts.append(held)
                held = line
            else:
                held = f"{held}\n{line}" if held else line
        return [(page, path, p.strip()) for p in [*parts, held] if p.strip()]

    def chunks(self, blocks: Iterable[tuple[int, str, str]]) -> Iterator[tuple[int, str, str]]:
        return (c for g in self.groups(blocks) for c in self.split(g))

    def __call__(self, blocks: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
        return list(self.chunks(blocks))


#: Blocks that are read, and chunks that are given on, at once.
ROWS = 1_000


def hierarchy_chunks(blocks: DataFrame, least: int = 200, most: int = 1500, merge_short: bool = True, id_col: str = "source_file") -> DataFrame:
    """``<id>, chunk_no, page, section_path, text`` from blocks with sizes and weights. Documents are dealt by id once; a task goes through its documents' blocks in order and holds a group at a time, however
    long a document is."""
    body = section_paths(heading_levels(blocks.repartition(id_col), id_col), id_col).select(id_col, "page", "block_no", "section_path", "text")
    pack = SectionPacker(least, most, merge_short)
    schema = f"`{id_col}` {body.schema[id_col].dataType.simpleString()}, chunk_no int, page int, section_path string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field(id_col).type, pa.int32(), pa.int32(), pa.string(), pa.string()]
                for lo in range(0, batch.num_rows, ROWS):
                    yield from zip(*(batch.column(c).slice(lo, ROWS).to_pylist() for c in (id_col, "page", "section_path", "text")), strict=True)

        def made() -> Iterator[tuple]:
            for doc, own in groupby(rows(), key=lambda r: r[0]):
                for no, chunk in enumerate(pack.chunks(r[1:] for r in own)):
                    yield doc, no, *chunk

        found = made()
        while some := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], [id_col, "chunk_no", "page", "section_path", "text"])

    return body.sortWithinPartitions(id_col, "page", "block_no").drop("block_no").mapInArrow(run, schema)


def semantic_groups(paragraphs: DataFrame, share: float = 0.85, id_col: str = "doc_id", vectors: DataFrame | None = None) -> DataFrame:
    """``<id>, group_no, page, text`` from ``<id>, para_no, page, text, embedding``: a group ends where the cosine distance to the next paragraph is
    at or over the document's ``share`` quantile. With ``vectors`` (``<id>, para_no, embedding``) paragraphs come without theirs, and those that have none are left out.

    Texts and vectors are rows of their own which meet in the one shuffle by document: neither is carried along with the other.
    """
    bare = paragraphs.select(id_col, "para_no", "page", "text")
    given = (paragraphs if vectors is None else vectors).select(id_col, "para_no", "embedding")
    nothing = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = given.select(id_col, "para_no", F.lit(1).alias("kind"), nothing("page", bare), nothing("text", bare), "embedding").unionByName(bare.select("*", F.lit(0).alias("kind"), nothing("embedding", given)))
    # vectors first, in order: what follows the last of them has none
    own = Window.partitionBy(id_col).orderBy(F.col("kind").desc(), "para_no")
    rows = both.withColumn("distance", F.round(1.0 - dot(F.col("embedding"), F.lead("embedding").over(own)), 9)).drop("embedding")
    rows = rows.withColumn("threshold", F.round(F.percentile("distance", F.lit(share)).over(Window.partitionBy(id_col)), 9))
    rows = rows.withColumn("ends", F.coalesce((F.col("distance") >= F.col("threshold")).cast("int"), F.lit(0))).drop("distance", "threshold")
    # then each text before its vector
    place = Window.partitionBy(id_col).orderBy("para_no", "kind")
    after = F.lead(F.struct("para_no", "kind")).over(place)
    rows = rows.withColumn("group_no", F.coalesce(F.sum("ends").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("met", (after["para_no"] == F.col("para_no")) & (after["kind"] == 1))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda p: p["text"])
    return rows.where("kind = 0 AND met").groupBy(id_col, "group_no").agg(F.min_by("page", "para_no").alias("page"), F.array_join(texts, "\n").alias("text"))


def enforce_size(groups: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """Texts over ``most`` characters cut into slices of it, each beginning ``least // 2`` before the last one's end; adds ``slice_no``."""
    n = F.length("text")
    starts = F.when(n > most, F.sequence(F.lit(0), n - 1, F.lit(most - least // 2))).otherwise(F.array(F.lit(0)))
    kept = [c for c in groups.columns if c != "text"]
    cut = groups.select(*kept, "text", F.posexplode(starts).alias("slice_no", "at"))
    return cut.select(*kept, "slice_no", F.when(n > most, F.substring("text", F.col("at") + 1, F.lit(most))).otherwise(F.col("text")).alias("text"))


def semantic_chunks(paragraphs: DataFrame, least: int = 100, most: int = 2000, share: float = 0.85, id_col: str = "doc_id", vectors: DataFrame | None = None) -> DataFrame:
    return enforce_size(semantic_groups(paragraphs, share, id_col, vectors), least, most)


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed_size": fixed_windows, "hierarchy": hierarchy_chunks, "semantic": semantic_chunks}


def chunker(strategy: str) -> Callable[..., DataFrame]:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return CHUNKERS[strategy]


def chunk_id(file: Column, strategy: str, order: Column) -> Column:
    """The same id for the same chunk in every run."""
    return F.sha1(F.concat_ws("|", file.cast("string"), F.lit(strategy), order.cast("string")))
