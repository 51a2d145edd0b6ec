"""Chunking and tables of contents over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.text import query_tokens, strip
from quarryline.jobs import tables as t
from quarryline.operators import chunking, export, matching, toc, verify
from quarryline.sources import corpus
from quarryline.sources.scratch import shared_path


def _page_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = t.lines(spark, sf_dir).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))
    return at.where("line_no % 5 = 0").select("doc_id", "start", (1 + F.floor(F.col("line_no") / 5)).cast("int").alias("page"))


_STARTS = t.LINES + """, starts AS (SELECT * FROM (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, (1 + line_no // 5)::INT AS page FROM lines) WHERE line_no % 5 = 0)"""
_WINDOWS = f""", wins AS (SELECT doc_id, win_no, win_start, {t.sql_strip("substring(text, win_start + 1, least(length(text), pos + 950) - win_start)")} AS text
  FROM (SELECT doc_id, text, pos // 800 AS win_no, greatest(0, pos - 150)::INT AS win_start, pos FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS pos FROM documents)))"""


def _shown(windows: DataFrame) -> DataFrame:
    return windows.select("doc_id", "win_no", "win_start", F.col("page").cast("int").alias("page"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


_PICK = "doc_id, win_no::INT AS win_no, win_start, {} AS page, length(text)::INT AS n_chars, md5(text) AS text_md5"


@t.query("fixed_chunks", f"WITH {_STARTS}{_WINDOWS} SELECT {_PICK.format('coalesce(page, 1)')} FROM wins LEFT JOIN starts ON wins.doc_id = starts.doc_id AND win_start = start WHERE text <> ''".replace("SELECT doc_id, win_no::INT", "SELECT wins.doc_id, win_no::INT"))
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return _shown(chunking.window_pages(chunking.fixed_windows(docs), _page_starts(spark, sf_dir)))


@t.query("fixed_chunks_asof", f"WITH {_STARTS}{_WINDOWS} SELECT {_PICK.format('coalesce((SELECT max(page) FROM starts s WHERE s.doc_id = wins.doc_id AND s.start <= wins.win_start), 1)')} FROM wins WHERE text <> ''")
def fixed_chunks_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return _shown(chunking.window_pages(chunking.fixed_windows(docs), _page_starts(spark, sf_dir), "asof"))


_LEVELS = f"""{t.BLOCKS}, clean AS (SELECT source_file, page, block_no, {t.sql_strip("text")} AS text, font_size, is_bold FROM blocks),
med AS (SELECT source_file, median(font_size) AS m FROM clean WHERE text <> '' GROUP BY 1),
lev AS (SELECT source_file, page, block_no, text, CASE WHEN length(text) > 80 THEN NULL
  WHEN regexp_matches(text, '^第[一二三四五六七八九十\\p{{Nd}}]+[章节篇]') THEN 1
  WHEN (font_size >= 1.25 * m OR is_bold AND font_size >= 1.1 * m) AND length(text) <= 40 THEN CASE WHEN font_size < 1.5 * m THEN 2 ELSE 1 END
  WHEN is_bold AND length(text) <= 30 THEN 3 END AS heading_level FROM clean JOIN med USING (source_file) WHERE text <> '')"""


@t.query("heading_levels", f"WITH {_LEVELS} SELECT source_file, page, block_no, heading_level FROM lev")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.heading_levels(t.blocks(spark, sf_dir)).select("source_file", "page", "block_no", "heading_level")


_SECTIONS = f"""{_LEVELS}, heads AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY page, block_no) AS rn FROM lev WHERE heading_level IS NOT NULL),
st AS (SELECT source_file, rn, block_no, [text] AS s FROM heads WHERE rn = 1
  UNION ALL SELECT h.source_file, h.rn, h.block_no, list_append(st.s[1:h.heading_level - 1], h.text) FROM st JOIN heads h ON h.source_file = st.source_file AND h.rn = st.rn + 1),
lasth AS (SELECT l.source_file, l.page, l.block_no, l.text, max(h.block_no) AS hb FROM lev l LEFT JOIN heads h ON h.source_file = l.source_file AND h.block_no < l.block_no WHERE l.heading_level IS NULL GROUP BY ALL),
sections AS (SELECT l.source_file, l.page, l.block_no, l.text, coalesce(array_to_string(st.s, '>'), '正文') AS section_path FROM lasth l LEFT JOIN st ON st.source_file = l.source_file AND st.block_no = l.hb)"""


@t.query("section_paths", f"WITH RECURSIVE {_SECTIONS} SELECT source_file, page, block_no, section_path FROM sections")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_paths(chunking.heading_levels(t.blocks(spark, sf_dir))).select("source_file", "page", "block_no", "section_path")


#: Block by block, then line by line: the group so far, and what ended at this step.
_PACKED = f"""{_SECTIONS}, body AS MATERIALIZED (SELECT source_file, page, text, section_path AS path, row_number() OVER (PARTITION BY source_file ORDER BY page, block_no) AS rn FROM sections),
steps AS (SELECT source_file, rn, page, path, text, NULL::INT AS end_page, NULL::VARCHAR AS end_path, NULL::VARCHAR AS end_text FROM body WHERE rn = 1
  UNION ALL SELECT source_file, rn, CASE WHEN stays THEN least(was_page, page) ELSE page END, CASE WHEN stays THEN was_path ELSE path END, CASE WHEN stays THEN joined ELSE text END,
   CASE WHEN stays THEN NULL WHEN meets THEN least(was_page, page) ELSE was_page END, CASE WHEN NOT stays THEN was_path END, CASE WHEN stays THEN NULL WHEN meets THEN joined ELSE was_text END
  FROM (SELECT *, meets AND length(joined) <= 1500 AS stays FROM (SELECT b.*, s.page AS was_page, s.path AS was_path, s.text AS was_text, s.text || chr(10) || b.text AS joined, (b.path = s.path AND length(s.text) + 1 + length(b.text) <= 1500) OR length(s.text) < 200 AS meets
   FROM steps s JOIN body b ON b.source_file = s.source_file AND b.rn = s.rn + 1))),
made AS MATERIALIZED (SELECT source_file, 2 * rn AS seq, end_page AS page, end_path AS path, end_text AS text FROM steps WHERE end_text IS NOT NULL
  UNION ALL SELECT source_file, 2 * rn + 1, page, path, text FROM steps JOIN (SELECT source_file, max(rn) AS rn FROM body GROUP BY 1) USING (source_file, rn)),
rows_ AS MATERIALIZED (SELECT source_file, seq, unnest(range(len(ls))) AS ln, unnest(ls) AS line, len(ls) - 1 AS last FROM (SELECT *, string_split(text, chr(10)) AS ls FROM made WHERE length(text) > 1500)),
cuts AS (SELECT source_file, seq, ln, line AS held, NULL::VARCHAR AS part FROM rows_ WHERE ln = 0
  UNION ALL SELECT r.source_file, r.seq, r.ln, CASE WHEN c.held = '' OR length(c.held) + 1 + length(r.line) > 1500 THEN r.line ELSE c.held || chr(10) || r.line END, CASE WHEN c.held <> '' AND length(c.held) + 1 + length(r.line) > 1500 THEN c.held END
  FROM cuts c JOIN rows_ r ON r.source_file = c.source_file AND r.seq = c.seq AND r.ln = c.ln + 1),
parts_ AS (SELECT source_file, seq, 2 * ln AS nth, part AS text FROM cuts WHERE part IS NOT NULL UNION ALL SELECT source_file, seq, 2 * ln + 1, held FROM cuts JOIN (SELECT DISTINCT source_file, seq, last AS ln FROM rows_) USING (source_file, seq, ln)),
packed AS (SELECT source_file, seq, 0 AS nth, page, path, text FROM made WHERE length(text) <= 1500
  UNION ALL SELECT * FROM (SELECT p.source_file, p.seq, nth, page, path, {t.sql_strip("p.text")} AS text FROM parts_ p JOIN made m ON m.source_file = p.source_file AND m.seq = p.seq) WHERE text <> ''),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY source_file ORDER BY seq, nth) - 1)::INT AS chunk_no FROM packed)"""


@t.query("hierarchy_chunks", f"WITH RECURSIVE {_PACKED} SELECT sha1(source_file || '|hierarchy|' || chunk_no) AS chunk_id, source_file, chunk_no, page, path AS section_path, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM numbered")
def hierarchy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.hierarchy_chunks(t.blocks(spark, sf_dir))
    return made.select(chunking.chunk_id(F.col("source_file"), "hierarchy", F.col("chunk_no")).alias("chunk_id"), "source_file", "chunk_no", "page", "section_path", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@t.query(
    "semantic_chunks",
    f"""WITH {t.LINES}, para AS (SELECT doc_id, line_no AS para_no, (1 + line_no // 5)::INT AS page, {t.sql_strip("line")} AS text, embedding::DOUBLE[] AS e FROM lines JOIN embeddings ON vec_id = (doc_id * 31 + line_no) % (SELECT max(vec_id) + 1 FROM embeddings) WHERE {t.sql_strip("line")} <> ''),
dist AS (SELECT *, round(1 - list_dot_product(e, lead(e) OVER (PARTITION BY doc_id ORDER BY para_no)), 9) AS d FROM para),
thr AS (SELECT doc_id, round(quantile_cont(d, 0.85), 9) AS th FROM dist GROUP BY 1),
grp AS (SELECT doc_id, para_no, page, text, coalesce(sum((coalesce(d >= th, false))::INT) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS group_no FROM dist JOIN thr USING (doc_id)),
txt AS (SELECT doc_id, group_no, arg_min(page, para_no) AS page, string_agg(text, chr(10) ORDER BY para_no) AS text FROM grp GROUP BY 1, 2),
cut AS (SELECT doc_id, group_no, page, text, CASE WHEN length(text) > 2000 THEN range(0, length(text), 1950) ELSE [0] END AS ats FROM txt),
sl AS (SELECT doc_id, group_no, page, text, unnest(range(len(ats))) AS slice_no, unnest(ats) AS pos FROM cut)
SELECT doc_id, group_no::BIGINT AS group_no, slice_no::INT AS slice_no, page, md5(CASE WHEN length(text) > 2000 THEN substring(text, pos + 1, 2000) ELSE text END) AS text_md5 FROM sl""",
)
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg((F.max("vec_id") + 1).alias("n_vectors"))
    rows = t.lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("para_no"), (1 + F.floor(F.col("line_no") / 5)).cast("int").alias("page"), strip(F.col("line")).alias("text")).where("text <> ''")
    numbered = rows.join(F.broadcast(n)).select("doc_id", "para_no", ((F.col("doc_id") * 31 + F.col("para_no")) % F.col("n_vectors")).alias("vec_id"))  # n has one row
    made = chunking.chunker("semantic")(rows, vectors=numbered.join(vectors, "vec_id").select("doc_id", "para_no", "embedding"))
    return made.select("doc_id", F.col("group_no").cast("long").alias("group_no"), "slice_no", "page", F.md5("text").alias("text_md5"))


@t.query("corpus_counts", f"WITH {t.CHUNKS} SELECT coalesce(vehicle_model, '*') AS vehicle_model, count(*) AS chunks FROM chunks GROUP BY ROLLUP (vehicle_model)")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.corpus_counts(t.chunks(spark, sf_dir))


@t.query("toc_paths", f"WITH RECURSIVE {t.TOC_PATHS} SELECT source_file, ord, path FROM paths")
def toc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.toc_paths(t.toc(spark, sf_dir)).select("source_file", "ord", "path")


@t.query("toc_leaves", f"WITH {t.TOC} SELECT source_file, ord, title FROM (SELECT *, lead(level) OVER (PARTITION BY source_file ORDER BY ord) AS after FROM toc) WHERE after IS NULL OR after <= level")
def toc_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.leaves(t.toc(spark, sf_dir)).select("source_file", "ord", "title")


_ENDS = """ends AS (SELECT {t}.*, coalesce(greatest({t}.page, (SELECT arg_min(page, ord) FROM toc o WHERE o.source_file = {t}.source_file AND o.ord > {t}.ord AND o.level <= {t}.level) - 1), (SELECT max(page) FROM toc)) AS end_page0,
  (SELECT arg_min(page, ord) FROM toc o WHERE o.source_file = {t}.source_file AND o.ord > {t}.ord AND o.level <= {t}.level) AS nxt FROM {t}),
ranged AS (SELECT *, (CASE WHEN nxt IS NULL THEN (SELECT max(page) FROM toc) ELSE greatest(page, nxt - 1) END)::INT AS end_page FROM ends)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = toc.toc_paths(t.toc(spark, sf_dir))
    last = entries.agg(F.max("page").alias("max_page"))
    return toc.page_ends(entries.join(F.broadcast(last)), F.col("max_page"), 4).drop("max_page")  # one row


@t.query("toc_ranges", f"WITH {t.TOC}, {_ENDS.format(t='toc')} SELECT source_file, ord, page, end_page FROM ranged")
def toc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("source_file", "ord", "page", "end_page")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.questions(spark, sf_dir).select("query_id", "vehicle_model", "question").withColumn("words", query_tokens(F.col("question"), F.lit(None).cast("string"), F.lit(None).cast("string")))


_ASKED = rf"""asked AS (SELECT query_id, vehicle_model, question, list_distinct(list_filter({t.TOKENS.format("question")}, lambda x: length(x) >= 2)) AS words FROM questions),
parts AS (SELECT p.*, list_filter(string_split(lower(path), '>'), lambda x: x <> '') AS pp, lower(path || '>' || title) AS hay FROM paths p),
raw AS (SELECT a.query_id, a.question, len(words) AS nw, p.*, coalesce(list_sum(list_transform(words, lambda w: (CASE WHEN contains(hay, w) THEN 1 ELSE 0 END) + 2 * len(list_filter(pp, lambda x: contains(x, w) OR contains(w, x))))), 0)::DOUBLE AS m
  FROM asked a JOIN parts p USING (vehicle_model)),
best AS (SELECT *, round(m + length(path) * 0.01 - CASE WHEN contains(path, 'The') AND NOT contains(question, 'The') THEN 3 ELSE 0 END, 6) AS score FROM raw),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, source_file) AS position FROM best WHERE nw > 0 AND score > 0) WHERE position <= 3)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With page ranges; as entries of many documents share a number here, the file decides among them."""
    return _ranges(spark, sf_dir).withColumn("ord", F.struct("ord", "source_file"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched_entries(_asked(spark, sf_dir), _entries(spark, sf_dir), 3, ["The"])


@t.query("bookmark_scores", f"WITH RECURSIVE {t.TOC_PATHS}, {t.QUESTIONS}, {_ASKED} SELECT query_id, source_file, ord, score, position::INT AS position FROM sel")
def bookmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("query_id", "source_file", F.col("ord.ord").alias("ord"), "score", "position")


@t.query(
    "bookmark_catalogue",
    f"""WITH RECURSIVE {t.TOC_PATHS}, {t.QUESTIONS}, {_ASKED}, flag AS (SELECT *, max(m) OVER (PARTITION BY query_id) > 0 AS any_hit FROM raw),
k AS (SELECT *, CASE WHEN nw = 0 THEN 0 WHEN any_hit THEN 1 ELSE 2 END AS kind FROM flag),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 1 THEN -round(m + length(path) * 0.01, 6) WHEN 2 THEN -level::DOUBLE ELSE 0.0 END, CASE WHEN kind = 2 THEN page ELSE 0 END, ord, source_file) AS position FROM k WHERE kind <> 1 OR m > 0)
SELECT query_id, source_file, ord, position::INT AS position FROM o WHERE position <= 80""",
)
def bookmark_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.catalogue(_asked(spark, sf_dir), _entries(spark, sf_dir)).select("query_id", "source_file", F.col("ord.ord").alias("ord"), "position")


_FIT = "(trim({0}) <> '' AND section_path <> '' AND (contains(section_path, trim({0})) OR len(list_filter(string_split(section_path, '>'), lambda x: contains(x, trim({0})) OR contains(trim({0}), x))) > 0))"


@t.query(
    "bookmark_chunks",
    f"""WITH RECURSIVE {t.TOC_PATHS}, {t.QUESTIONS}, {t.CHUNKS}, {_ASKED}, {_ENDS.format(t="sel")},
c AS (SELECT r.query_id, r.position, chunks.chunk_id, row_number() OVER (PARTITION BY r.query_id, r.position ORDER BY CASE WHEN {_FIT.format("title")} OR {_FIT.format("path")} THEN 0 ELSE 1 END, chunks.page, chunk_ord) AS nth
  FROM ranged r JOIN chunks USING (vehicle_model) WHERE chunks.page BETWEEN r.page AND r.end_page),
f AS (SELECT query_id, chunk_id, min(position * 1000 + nth) AS place FROM c WHERE nth <= 2 GROUP BY 1, 2)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS position FROM f""",
)
def bookmark_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.chunks_of_entries(_selected(spark, sf_dir), t.chunks(spark, sf_dir), 2, "vehicle_model")


@t.query(
    "response_paths",
    f"""WITH RECURSIVE {t.TOC_PATHS}, r AS (SELECT doc_id::VARCHAR AS source_file, doc_id AS response_id, text AS response FROM documents), p AS (SELECT source_file, path, min(ord) AS ord FROM paths WHERE path <> '' GROUP BY 1, 2),
m AS (SELECT response_id, path, row_number() OVER (PARTITION BY response_id ORDER BY length(path) DESC, ord) AS position FROM r JOIN p USING (source_file) WHERE contains(response, path))
SELECT response_id, path, position::INT AS position FROM m WHERE position <= 3""",
)
def response_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), F.col("doc_id").alias("response_id"), F.col("text").alias("response"))
    return toc.named_paths(responses, toc.toc_paths(t.toc(spark, sf_dir)))


@t.query(
    "response_indices",
    r"""WITH r AS (SELECT doc_id, (doc_id % 23)::VARCHAR AS a, (doc_id % 9)::VARCHAR AS b, (doc_id % 17)::VARCHAR AS c, doc_id % 4 AS k FROM documents),
l AS (SELECT doc_id, CASE k WHEN 0 THEN [a, b, c, a] WHEN 1 THEN CASE WHEN len(list_filter([b, c], lambda x: x::INT BETWEEN 1 AND 15)) > 0 THEN [b, c] ELSE [] END WHEN 2 THEN [] ELSE [] END AS nums FROM r),
v AS (SELECT doc_id, list_filter(list_transform(nums, lambda x: x::INT), lambda x: x BETWEEN 1 AND 15) AS ok FROM l),
u AS (SELECT doc_id, list_filter(ok, lambda x, i: list_position(ok, x) = i) AS once FROM v)
SELECT doc_id, array_to_string(once[1:3], ',') AS picked FROM u""",
)
def response_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    a, b, c = [(d % n).cast("string") for n in (23, 9, 17)]
    response = F.when(d % 4 == 0, F.concat_ws("，", a, b, c, a)).when(d % 4 == 1, F.concat(F.lit("see:\n"), b, F.lit(" , "), c, F.lit("\n2. title"))).when(d % 4 == 2, F.lit("无")).otherwise(F.concat(a, F.lit(". title")))
    picked = toc.named_numbers(response, 15)
    return t.table(spark, sf_dir, "documents").select("doc_id", F.array_join(picked.cast("array<string>"), ",").alias("picked"))


#: Of the catalogue by position: the path of every third question, numbers of the next, nothing of the others, of which some calls fail.
_PICKED = f"""WITH RECURSIVE {t.TOC_PATHS}, {t.QUESTIONS}, {_ASKED}, flag AS (SELECT *, max(m) OVER (PARTITION BY query_id) > 0 AS any_hit FROM raw JOIN (SELECT query_id, words FROM asked) USING (query_id)),
k AS (SELECT *, CASE WHEN nw = 0 THEN 0 WHEN any_hit THEN 1 ELSE 2 END AS kind FROM flag),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 1 THEN -round(m + length(path) * 0.01, 6) WHEN 2 THEN -level::DOUBLE ELSE 0.0 END, CASE WHEN kind = 2 THEN page ELSE 0 END, ord, source_file) AS position FROM k WHERE kind <> 1 OR m > 0),
shown AS MATERIALIZED (SELECT *, CASE WHEN length(question) % 5 = 4 THEN 'fails' WHEN length(question) % 5 = 3 THEN 'none' WHEN length(question) % 5 >= 1 THEN 'path' ELSE 'number' END AS how FROM o WHERE position <= 80),
said AS (SELECT query_id, 'see ' || path || ' now' AS response FROM shown WHERE how = 'path' AND position = 1),
np AS (SELECT query_id, path, arg_min(ord, (ord, source_file)) AS ord, arg_min(source_file, (ord, source_file)) AS source_file FROM shown JOIN said USING (query_id) WHERE path <> '' AND contains(response, path) GROUP BY 1, 2),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(path) DESC, ord, source_file) AS position FROM np),
w AS (SELECT s.query_id, s.path, s.ord, s.source_file, round(m + length(path) * 0.01 - CASE WHEN contains(path, 'The') AND NOT contains(question, 'The') THEN 3 ELSE 0 END, 6) AS score FROM shown s WHERE how = 'none' AND nw > 0),
wr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, source_file) AS position FROM w WHERE score > 0)
SELECT query_id, source_file, ord, 'path' AS picked_by, position::INT AS position FROM pr WHERE position <= 3
UNION ALL SELECT query_id, source_file, ord, 'number', (CASE position WHEN 2 THEN 1 ELSE 2 END)::INT FROM shown WHERE how = 'number' AND position IN (2, 3)
UNION ALL SELECT query_id, source_file, ord, 'keyword', position::INT FROM wr WHERE position <= 3
UNION ALL SELECT query_id, source_file, ord, 'whole catalogue', position::INT FROM sel WHERE length(question) % 5 = 4 OR (length(question) % 5 = 3 AND query_id NOT IN (SELECT query_id FROM wr))"""


def _selector():  # noqa: ANN202
    """A completion function for tests: by the question's length it names the first path, two numbers or nothing, or fails."""

    def ask(prompt: str) -> str:
        length, rest = prompt.split("\n", 1)
        kind = int(length) % 5
        if kind == 4:
            raise ValueError("no answer")
        return "unsure" if kind == 3 else "2,3" if kind == 0 else f"see {rest.split('. ', 1)[1].split(chr(10) + '2. ', 1)[0]} now"

    return ask


@t.query("bookmark_evidence", _PICKED)
def bookmark_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a completion names from each question's catalogue; where it names none keywords choose from it, and from all entries where it fails."""
    prompt = lambda question, catalogue: F.concat_ws("\n", F.length(question).cast("string"), catalogue)
    picked = verify.select_entries(_asked(spark, sf_dir), _entries(spark, sf_dir), _selector, general=["The"], prompt=prompt)
    return picked.select("query_id", F.col("ord.source_file").alias("source_file"), F.col("ord.ord").alias("ord"), "picked_by", F.col("position").cast("int").alias("position"))


@t.query("blocks_read", f"WITH {t.BLOCKS} SELECT source_file, page, block_no, md5(text) AS text_md5, font_size, is_bold FROM blocks WHERE {t.sql_strip("text")} <> ''")
def blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed blocks written and read back without the blank ones."""
    path = shared_path(spark, "blocks")
    t.blocks(spark, sf_dir).select("source_file", "page", "block_no", "text", "font_size", "is_bold").write.parquet(path)
    return corpus.read_blocks(spark, path).withColumn("text_md5", F.md5("text")).drop("text")


@t.query(
    "corpus_json",
    f"""WITH {t.LINES} SELECT doc_id || ':' || line_no AS chunk_id, md5(line) AS text_md5, coalesce(source, '') AS vehicle_model, '' AS doc_type, CASE WHEN line_no % 3 > 0 THEN (1 + line_no)::INT END AS page, 's' || line_no % 7 AS section_path FROM lines""",
)
def corpus_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column-oriented corpora, one for each document, of its lines; missing facts are empty."""
    n = F.col("line_no")
    fact = {"chunk_id": F.lit(None), "vehicle_model": F.col("source"), "doc_type": F.lit(None), "source_file": F.lit(None), "page": F.when(n % 3 > 0, 1 + n), "section_path": F.concat(F.lit("s"), (n % 7).cast("string"))}
    meta = F.struct(*[c.cast("int" if k == "page" else "string").alias(k) for k, c in fact.items()], F.array().cast("array<string>").alias("image_refs"))
    rows = t.lines(spark, sf_dir).select("doc_id", F.struct(n, F.concat_ws(":", "doc_id", "line_no").alias("id"), "line", meta.alias("meta")).alias("r"))
    one = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # a document's lines
    path = shared_path(spark, "corpora")
    one.select(F.col("rs.id").alias("chunk_ids"), F.col("rs.line").alias("texts"), F.col("rs.meta").alias("metadatas")).write.json(path)
    return corpus.read_corpus_json(spark, path, lines=True).withColumn("text_md5", F.md5("text")).drop("text")


@t.query("toc_roundtrip", f"WITH RECURSIVE {t.TOC_PATHS} SELECT source_file, vehicle_model, ord, level, title, page, path FROM paths")
def toc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents written to two folders, as of two runs, and read back one after another."""
    rows = toc.toc_paths(t.toc(spark, sf_dir))
    paths = [shared_path(spark, "toc") for _ in range(2)]
    for i, path in enumerate(paths):
        corpus.write_toc(rows.where(F.pmod(F.crc32("source_file"), F.lit(2)) == i), path)
    return corpus.read_toc(spark, paths)
