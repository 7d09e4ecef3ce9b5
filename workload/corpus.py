"""Sectioning, chunking and tagging over texts derived from the documents and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import chunking as ck
from loomstone.operators import ingest as ing
from loomstone.operators import sections as se
from loomstone.operators import tagging as tg
from loomstone.session import fresh_path, staged
from loomstone.sources import files as fi
from workload.base import BREAK_SQL, WS_SQL, paragraphs_sql, query, quoted, source, squeeze_sql, strip_sql, table

NL = "chr(10)"

# ---------------------------------------------------------------- derived texts


def marked(spark, sf):
    """Documents with every fifth line made a heading."""
    ls = F.transform(F.split("text", "\n"), lambda l, i: F.when(i % 5 == 0, F.concat(F.lit("## "), l)).otherwise(l))
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.array_join(ls, "\n").alias("text"))


MARKED = f"""marked AS (SELECT doc_id, lang, source, array_to_string(list_transform(string_split(text, {NL}),
  lambda l, i: CASE WHEN (i - 1) % 5 = 0 THEN '## ' || l ELSE l END), {NL}) AS text FROM documents)"""


def spaced(spark, sf):
    """Marked documents with a blank line after every line, so that each line is a paragraph."""
    return marked(spark, sf).withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))


SPACED = MARKED + f", spaced AS (SELECT doc_id, lang, source, replace(text, {NL}, {NL} || {NL}) AS text FROM marked)"

LINES = f"""ls AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no
  FROM (SELECT doc_id, regexp_split_to_array(text, {BREAK_SQL}) AS a FROM marked))"""


def _m(l):
    return lambda p: f"regexp_matches({l}, {quoted(p)})"


def _x(l):
    return lambda p, g: strip_sql(f"regexp_extract({l}, {quoted(p)}, {g})")


def marker_sql(l):
    m, x = _m(l), _x(l)
    num = f"{m(se.NUMBER_HEADING)} AND length({x(se.NUMBER_HEADING, 2)}) <= {se.NUMBER_TITLE_CHARS}"
    kind = (
        f"CASE WHEN {m(se.MD_HEADING)} THEN 'md_h' || length(regexp_extract({l}, {quoted(se.MD_HEADING)}, 1)) WHEN {m(se.MARK_HEADING)} THEN 'marker' "
        f"WHEN {m(se.BRACKET_HEADING)} THEN 'bracket' WHEN {num} THEN 'num' END"
    )
    title = (
        f"CASE WHEN {m(se.MD_HEADING)} THEN {x(se.MD_HEADING, 2)} WHEN {m(se.MARK_HEADING)} THEN {x(se.MARK_HEADING, 1)} "
        f"WHEN {m(se.BRACKET_HEADING)} THEN {x(se.BRACKET_HEADING, 1)} WHEN {num} THEN {x(se.NUMBER_HEADING, 2)} END"
    )
    return kind, title


_KIND, _TITLE = marker_sql("s")
MARKS = f"marks AS (SELECT *, {_KIND} AS kind, {_TITLE} AS title FROM (SELECT *, {strip_sql('line')} AS s FROM ls))"
DOC_TITLE = f"""doc_titles AS (SELECT doc_id, coalesce((SELECT arg_min(coalesce(title, s), line_no) FROM marks m
  WHERE m.doc_id = d.doc_id AND line_no < 5 AND (title IS NOT NULL OR (s <> '' AND length(s) <= {se.DOC_TITLE_CHARS}))), '') AS doc_title
  FROM documents d)"""
SECTIONS = f"""
sec0 AS (SELECT *, sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM marks),
sec1 AS (SELECT doc_id, sec, max(title) AS title, {strip_sql(f"coalesce(string_agg(line, {NL} ORDER BY line_no) FILTER (kind IS NULL), '')")} AS body
         FROM sec0 GROUP BY doc_id, sec),
sec2 AS (SELECT doc_id, sec, CASE WHEN sec = 0 THEN doc_title ELSE title END AS title, doc_title, body FROM sec1 JOIN doc_titles USING (doc_id) WHERE body <> ''),
sections AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS INTEGER) AS unit_index, title, doc_title AS section_path,
               CASE WHEN title <> '' THEN '# ' || title || {NL} || {NL} || body ELSE body END AS text FROM sec2
             UNION ALL
             SELECT doc_id, 1, doc_title, doc_title, {strip_sql('text')} FROM marked JOIN doc_titles USING (doc_id)
             WHERE {strip_sql('text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM sec2))"""


@query("detect_section_marker", f"WITH {MARKED}, {LINES}, {MARKS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind, title FROM marks WHERE kind IS NOT NULL")
def detect_section_marker(spark, sf):
    return se.detect_section_marker(marked(spark, sf), "doc_id", "text")


@query("guess_doc_title", f"WITH {MARKED}, {LINES}, {MARKS}, {DOC_TITLE} SELECT doc_id, doc_title AS title FROM doc_titles")
def guess_doc_title(spark, sf):
    return se.guess_doc_title(marked(spark, sf), "doc_id", "text")


@query("text_sections", f"WITH {MARKED}, {LINES}, {MARKS}, {DOC_TITLE}, {SECTIONS} SELECT *, 'section' AS unit_type FROM sections")
def text_sections(spark, sf):
    return se.text_sections(marked(spark, sf), "doc_id", "text")


# ---------------------------------------------------------------- pages: ten lines each, some with a section or part head

def pages(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.withColumn("page", F.floor(F.col("n") / 4).cast("long"))
    head = (
        F.when((F.col("n") % 12) == 0, F.concat((F.col("n") / 12 + 1).cast("int").cast("string"), F.lit(". "), F.col("line")))
        .when((F.col("n") % 20) == 8, F.concat(F.lit("PART "), F.col("n").cast("string")))
        .otherwise(F.col("line"))
    )
    packed = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("n", head.alias("l")))).alias("b"))
    return packed.select("doc_id", "page", F.array_join(F.transform("b", lambda x: x["l"]), "\n").alias("text"))


PAGES = f"""
pl AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, {NL}) AS a FROM documents)),
pages_d AS (SELECT doc_id, n // 4 AS page, string_agg(CASE WHEN n % 12 = 0 THEN (n // 12 + 1) || '. ' || line
              WHEN n % 20 = 8 THEN 'PART ' || n ELSE line END, {NL} ORDER BY n) AS text FROM pl GROUP BY 1, 2)"""

_pm = quoted(se.PAGE_MARKER)
_sub = lambda r: (
    f"CASE WHEN NOT starts_with({r}, '|') AND length({r}) <= {se.SUBTITLE_CHARS} AND {strip_sql(f'ltrim({r}, {quoted(se.SUBTITLE_MARKS)})')} <> '' "
    f"AND NOT starts_with({strip_sql(f'ltrim({r}, {quoted(se.SUBTITLE_MARKS)})')}, '|') THEN {strip_sql(f'ltrim({r}, {quoted(se.SUBTITLE_MARKS)})')} END"
)


@query("page_title", f"""WITH {PAGES},
r AS (SELECT doc_id, page, list_filter(list_transform(regexp_split_to_array(CASE WHEN page % 3 = 0 THEN '#' || text ELSE text END, {BREAK_SQL}), lambda l: {strip_sql('l')}), lambda l: l <> '') AS a FROM pages_d),
c AS (SELECT *, list_filter(a[1:4], lambda l: NOT regexp_matches(l, {_pm}))[1] AS p, list_position(list_transform(a[1:12], lambda l: starts_with(l, '#')), true) AS h FROM r),
d AS (SELECT *, CASE WHEN NOT starts_with(p, '#') AND NOT (ends_with(p, '다.') OR ends_with(p, '요.') OR ends_with(p, '음.')) THEN p END AS plain,
        {strip_sql("ltrim(a[h], '#')")} AS main, {_sub('a[h+1]')} AS s1, {_sub('a[h+2]')} AS s2 FROM c),
e AS (SELECT *, CASE WHEN h IS NOT NULL THEN concat_ws(' ', main, s1, CASE WHEN s1 IS NOT NULL THEN s2 END) END AS headed FROM d),
f AS (SELECT doc_id, page, CASE WHEN length(plain) BETWEEN 2 AND 120 THEN plain END AS x, CASE WHEN length(headed) BETWEEN 2 AND 120 THEN headed END AS y FROM e)
SELECT doc_id, page, CASE WHEN x IS NULL OR length(y) > length(x) THEN coalesce(y, x, '') ELSE x END AS title FROM f""")
def page_title(spark, sf):
    text = F.when(F.col("page") % 3 == 0, F.concat(F.lit("#"), "text")).otherwise(F.col("text"))
    return pages(spark, sf).select("doc_id", "page", se.page_title(text).alias("title"))


@query("carry_section", f"""WITH {PAGES}, h AS (SELECT doc_id, page, nullif({strip_sql(f"regexp_extract(left(text, 300), {quoted('(?m)(' + se.SECTION_HEAD + ')')}, 1)")}, '') AS s FROM pages_d)
SELECT doc_id, page, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page), '') AS section FROM h""")
def carry_section(spark, sf):
    return se.carry_section(pages(spark, sf)).select("doc_id", "page", "section")


@query("carry_part", f"""WITH {PAGES}, h AS (SELECT doc_id, page, nullif(regexp_extract(string_split(text, {NL})[1] || {NL} || text, {quoted('(?m)' + se.PART_HEAD)}, 1), '') AS s FROM pages_d)
SELECT doc_id, page AS slide, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page), '') AS part FROM h""")
def carry_part(spark, sf):
    slides = pages(spark, sf).select("doc_id", F.col("page").alias("slide"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    return se.carry_part(slides).select("doc_id", "slide", "part")


# ---------------------------------------------------------------- shapes: six lines a slide, the first its title, the fifth a table of its words


def two_rows(line):
    """All words of a line as a table of two rows."""
    cells = F.split(line, " ")
    half = F.floor((F.size(cells) + 1) / 2).cast("int")
    return F.array(F.slice(cells, F.lit(1), half), F.slice(cells, half + 1, F.size(cells) - half))


_two_rows = "[string_split(line, ' ')[1:(len(string_split(line, ' ')) + 1) // 2], string_split(line, ' ')[(len(string_split(line, ' ')) + 1) // 2 + 1:]]"


def shapes(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    slide, at = F.floor(F.col("n") / 6) + 1, F.col("n") % 6
    kind = F.when(at == 0, "title").when(at == 4, "table").when(at == 5, "notes").otherwise("text")
    part = F.when(F.col("n") % 18 == 7, F.concat(F.lit("PART "), F.col("n").cast("string"), F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    text = F.when(kind.isin("title", "notes"), F.col("line")).when(kind == "text", part)
    grid = two_rows(F.col("line"))
    return rows.select("doc_id", slide.cast("int").alias("slide"), F.col("n").alias("pos"), kind.alias("kind"), text.alias("text"), F.when(kind == "table", grid).alias("rows"))


def _cell(c):
    return strip_sql(f"replace(replace({c}, '|', '\\|'), {NL}, ' ')")


def pipe_sql(rows):
    """SQL for a pipe table of a list of lists of strings named by ``rows``."""
    width = f"list_max(list_transform({rows}, lambda r: len(r)))"
    line = f"lambda r: '| ' || array_to_string(list_transform(range(1, {width} + 1), lambda i: coalesce({_cell('r[i]')}, '')), ' | ') || ' |'"
    return (
        f"array_to_string(list_concat(list_transform({rows}[1:1], {line}), ['|' || array_to_string(list_transform(range(0, {width}), lambda i: '---'), '|') || '|'], "
        f"list_transform({rows}[2:], {line})), {NL})"
    )


_kept = f"list_filter(grid, lambda r: len(list_filter(r, lambda c: {strip_sql('c')} <> '')) > 0)"
SHAPES = f"""
sl AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, {NL}) AS a FROM documents)),
shp AS (SELECT doc_id, n // 6 + 1 AS slide, n AS pos,
          CASE n % 6 WHEN 0 THEN 'title' WHEN 4 THEN 'table' WHEN 5 THEN 'notes' ELSE 'text' END AS kind,
          {strip_sql(f"CASE n % 6 WHEN 4 THEN '' ELSE CASE WHEN n % 18 = 7 THEN 'PART ' || n || {NL} || line ELSE line END END")} AS text,
          {_two_rows} AS grid FROM sl),
slides AS (SELECT doc_id, slide, coalesce(max(text) FILTER (kind = 'title'), '') AS title,
             coalesce(list(text ORDER BY pos) FILTER (kind = 'text' AND text <> ''), []) AS bodies,
             coalesce(max(text) FILTER (kind = 'notes'), '') AS notes,
             coalesce(list({_kept} ORDER BY pos) FILTER (kind = 'table' AND len({_kept}) > 0), []) AS tables
           FROM shp GROUP BY 1, 2),
slides2 AS (SELECT *, array_to_string(bodies, {NL} || {NL}) AS body FROM slides),
slides3 AS (SELECT *, coalesce(last_value(nullif(regexp_extract(title || {NL} || body, {quoted('(?m)' + se.PART_HEAD)}, 1), '') IGNORE NULLS)
             OVER (PARTITION BY doc_id ORDER BY slide), '') AS part FROM slides2)"""

_UNIT_COLS = ["doc_id", "unit_index", "unit_type", "title", "section_path", "text", "is_table", "table_index", "parent_page_index"]


@query("slide_units", f"""WITH {SHAPES},
own AS (SELECT doc_id, slide AS unit_index, 'slide' AS unit_type, title, part AS section_path,
          concat_ws({NL} || {NL}, CASE WHEN title <> '' THEN '# ' || title END, nullif(body, '')) AS text, false AS is_table, NULL AS table_index, NULL AS parent_page_index, len(tables) AS nt FROM slides3),
tb AS (SELECT *, unnest(tables) AS rows, generate_subscripts(tables, 1) AS t FROM slides3)
SELECT doc_id, CAST(unit_index AS INTEGER) AS unit_index, unit_type, title, section_path, text, is_table, CAST(table_index AS INTEGER) AS table_index, CAST(parent_page_index AS INTEGER) AS parent_page_index FROM own WHERE text <> '' OR nt > 0
UNION ALL SELECT doc_id, CAST(slide * 1000 + t AS INTEGER), 'table', CASE WHEN title <> '' THEN title || ' — 표 ' || t ELSE '슬라이드 ' || slide || ' 표 ' || t END, part,
  {pipe_sql('rows')}, true, CAST(t AS INTEGER), CAST(slide AS INTEGER) FROM tb""")
def slide_units(spark, sf):
    return se.slide_units(shapes(spark, sf)).select(*_UNIT_COLS)


@query("shape_subchunks", f"""WITH {SHAPES},
p AS (SELECT *, list_filter(bodies, lambda b: length(b) BETWEEN 20 AND 500) AS parts FROM slides3),
u AS (SELECT *, unnest(parts) AS text, generate_subscripts(parts, 1) AS i FROM p WHERE len(parts) >= 3)
SELECT doc_id, CAST(slide * 1000 + 100 + i AS INTEGER) AS unit_index, 'slide_subchunk' AS unit_type,
  CASE WHEN title <> '' THEN title || ' — 항목 ' || i ELSE '슬라이드 ' || slide || ' 항목 ' || i END AS title, part AS section_path, text,
  false AS is_table, CAST(NULL AS INTEGER) AS table_index, CAST(slide AS INTEGER) AS parent_page_index FROM u""")
def shape_subchunks(spark, sf):
    return se.shape_subchunks(shapes(spark, sf)).select(*_UNIT_COLS)


@query("flat_document_text", f"""WITH {SHAPES},
b AS (SELECT doc_id, slide, array_to_string(list_concat(['## 슬라이드 ' || slide], CASE WHEN title <> '' THEN ['### ' || title] ELSE [] END, bodies,
        list_transform(tables, lambda t: {pipe_sql('t')}), CASE WHEN notes <> '' THEN ['### 발표자 노트' || {NL} || notes] ELSE [] END), {NL} || {NL}) AS block FROM slides)
SELECT doc_id, length(string_agg(block, {NL} || {NL} ORDER BY slide)) AS full_chars, left(string_agg(block, {NL} || {NL} ORDER BY slide), 8000) AS context FROM b GROUP BY doc_id""")
def flat_document_text(spark, sf):
    return se.flat_document_text(shapes(spark, sf))


# ---------------------------------------------------------------- paragraphs with levels


def heading_items(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    n = F.col("pos")
    level = F.when(n % 7 == 0, 1).when(n % 5 == 3, 2).when(n % 11 == 4, 3).otherwise(0)
    grid = F.when(n % 9 == 2, two_rows(F.col("text")))
    return rows.select("doc_id", n.cast("long").alias("pos"), level.alias("level"), "text", grid.alias("rows"))


@query("heading_sections", f"""WITH hl AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, {NL}) AS a FROM documents)),
it AS (SELECT doc_id, n, n % 9 = 2 AS tab, CASE WHEN n % 7 = 0 THEN 1 WHEN n % 5 = 3 THEN 2 WHEN n % 11 = 4 THEN 3 ELSE 0 END AS level, {strip_sql('line')} AS text,
         {_two_rows} AS grid FROM hl),
ik AS (SELECT * FROM (SELECT * REPLACE ({_kept} AS grid) FROM it) WHERE CASE WHEN tab THEN len(grid) > 0 ELSE text <> '' END),
w AS (SELECT *, sum(CASE WHEN NOT tab AND level IN (1, 2) THEN 1 ELSE 0 END) OVER o AS brk, sum(CASE WHEN tab THEN 1 ELSE 0 END) OVER o AS table_no,
        coalesce(last_value(CASE WHEN NOT tab AND level = 1 THEN text END IGNORE NULLS) OVER o, '') AS h1,
        coalesce(last_value(CASE WHEN NOT tab AND level = 2 THEN text WHEN NOT tab AND level = 1 THEN '' END IGNORE NULLS) OVER o, '') AS h2
      FROM ik WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
s AS (SELECT doc_id, brk, max(h1) AS h1, max(h2) AS h2, count(*) FILTER (NOT tab AND level NOT IN (1, 2)) AS paras,
        string_agg(CASE WHEN level >= 3 THEN '### ' || text ELSE text END, {NL} || {NL} ORDER BY n) FILTER (NOT tab AND level NOT IN (1, 2)) AS body FROM w GROUP BY 1, 2),
x AS (SELECT *, sum(CASE WHEN paras > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY brk) AS idx, concat_ws(' / ', nullif(h1, ''), nullif(h2, '')) AS path,
        coalesce(nullif(h2, ''), nullif(h1, '')) AS name FROM s)
SELECT doc_id, CAST(idx AS BIGINT) AS unit_index, 'section' AS unit_type, coalesce(name, '섹션 ' || idx) AS title, path AS section_path,
  '# ' || coalesce(name, '섹션 ' || idx) || {NL} || {NL} || body AS text, false AS is_table, CAST(NULL AS BIGINT) AS table_index, CAST(NULL AS BIGINT) AS parent_page_index FROM x WHERE paras > 0
UNION ALL SELECT w.doc_id, CAST(10000 + table_no AS BIGINT), 'table', coalesce(x.name, '본문') || ' — 표 ' || table_no, path, {pipe_sql('grid')}, true, CAST(table_no AS BIGINT),
  CAST(idx - CASE WHEN paras > 0 THEN 1 ELSE 0 END + 1 AS BIGINT) FROM w JOIN x ON x.doc_id = w.doc_id AND x.brk = w.brk WHERE tab""")
def heading_sections(spark, sf):
    return se.heading_sections(heading_items(spark, sf)).select(*_UNIT_COLS)


@query("flat_paragraph_text", f"""WITH hl AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, {NL}) AS a FROM documents)),
it AS (SELECT doc_id, n, n % 9 = 2 AS tab, {strip_sql('line')} AS text, {_two_rows} AS grid, count(*) FILTER (n % 9 = 2) OVER (PARTITION BY doc_id ORDER BY n) AS no FROM hl),
b AS (SELECT doc_id, tab, n, CASE WHEN tab THEN '## 표 ' || no || {NL} || {NL} || {pipe_sql('kept')} ELSE text END AS block FROM (SELECT *, {_kept} AS kept FROM it) WHERE CASE WHEN tab THEN len(kept) > 0 ELSE text <> '' END)
SELECT doc_id, length(string_agg(block, {NL} || {NL} ORDER BY tab, n)) AS full_chars, left(string_agg(block, {NL} || {NL} ORDER BY tab, n), 8000) AS context FROM b GROUP BY doc_id""")
def flat_paragraph_text(spark, sf):
    return se.flat_paragraph_text(heading_items(spark, sf))


# ---------------------------------------------------------------- tables of orders


def order_rows(spark, sf):
    """Header row and one row per line item; the key of the table is the order."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("row_no"),
        F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.concat("l_returnflag", F.lit("|"), "l_linestatus"),
                F.col("l_suppkey").cast("string")).alias("cells"),
    )
    head = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.struct(F.lit(-1).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey")).alias("row_no"),
        F.array(F.lit("line"), F.lit("part"), F.col("o_orderpriority")).alias("cells"),
    )
    return head.unionByName(li)


ORDER_ROWS = """
orow AS (SELECT o_orderkey AS doc_id, -1 AS ln, CAST(0 AS BIGINT) AS pk, CAST(0 AS BIGINT) AS sk, ['line', 'part', o_orderpriority] AS cells FROM orders
         UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag || '|' || l_linestatus, CAST(l_suppkey AS VARCHAR)] FROM lineitem),
otab AS (SELECT doc_id, list(cells ORDER BY ln, pk, sk) AS rows FROM orow GROUP BY doc_id)"""


@query("markdown_table", f"WITH {ORDER_ROWS} SELECT doc_id, {pipe_sql('rows')} AS \"table\" FROM otab")
def markdown_table(spark, sf):
    return se.markdown_table(order_rows(spark, sf), ["doc_id"])


@query("sheet_units", f"""WITH {ORDER_ROWS} SELECT o_custkey AS doc_id, CAST(doc_id AS INTEGER) AS unit_index, o_orderstatus || doc_id AS title,
  '# 시트: ' || o_orderstatus || doc_id || {NL} || {NL} || {pipe_sql('rows')} AS text, CAST(len(rows) AS INTEGER) AS row_count, CAST(list_max(list_transform(rows, lambda r: len(r))) AS INTEGER) AS col_count
FROM otab JOIN orders ON o_orderkey = doc_id""")
def sheet_units(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus")
    rows = order_rows(spark, sf).join(o, "doc_id")
    sheets = rows.select(F.col("o_custkey").alias("doc_id"), F.col("doc_id").cast("int").alias("sheet_no"), F.concat("o_orderstatus", rows["doc_id"].cast("string")).alias("sheet"), "row_no", "cells")
    return se.sheet_units(sheets)


@query("flat_sheet_text", f"""WITH {ORDER_ROWS}, b AS (SELECT o_custkey AS doc_id, doc_id AS sheet_at, '## 시트: ' || o_orderstatus || doc_id || {NL} || {NL} || {pipe_sql('rows')} AS block FROM otab JOIN orders ON o_orderkey = doc_id)
SELECT doc_id, length(string_agg(block, {NL} || {NL} ORDER BY sheet_at)) AS full_chars, left(string_agg(block, {NL} || {NL} ORDER BY sheet_at), 8000) AS context FROM b GROUP BY doc_id""")
def flat_sheet_text(spark, sf):
    """A customer's orders as the sheets of a workbook; rows are numbered in their order."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus")
    rows = order_rows(spark, sf).join(o, "doc_id")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no"))
    return se.flat_sheet_text(rows.select(F.col("o_custkey").alias("doc_id"), F.col("doc_id").alias("sheet_no"), F.concat("o_orderstatus", rows["doc_id"].cast("string")).alias("sheet"), at.alias("row_no"), "cells"))


# ---------------------------------------------------------------- damage: documents with some letters lost, as a broken font would lose them


def damaged(spark, sf):
    t = F.col("text")
    bad = F.when(F.col("lang") == "de", F.replace(F.replace(t, F.lit("sch"), F.lit("(cid:19)")), F.lit("ei"), F.lit("㎼"))).when(
        F.col("lang") == "es", F.replace(F.replace(t, F.lit(". "), F.lit("●")), F.lit("o A"), F.lit("가Abc"))
    ).otherwise(t)
    return table(spark, sf, "documents").select("doc_id", "lang", bad.alias("text"), (F.length("source") == 4).alias("has_images"))


DAMAGED = """damaged AS (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN replace(replace(text, 'sch', '(cid:19)'), 'ei', '㎼')
  WHEN lang = 'es' THEN replace(replace(text, '. ', '●'), 'o A', '가Abc') ELSE text END AS text, length(source) = 4 AS has_images FROM documents)"""


def broken_sql(x):
    return f"(len(regexp_extract_all({x}, {quoted(se.CID)})) + len(regexp_extract_all({x}, {quoted(se.ODD_GLYPH)})))"


def flat_sql(x):
    return f"(regexp_matches({x}, {quoted(se.DIGIT_RUN)}) OR regexp_matches({x}, {quoted(se.GLUED_BULLET)}) OR len(regexp_extract_all({x}, {quoted(se.GLUED_CELL)})) >= 3)"


@query("broken_glyphs", f"WITH {DAMAGED} SELECT doc_id, CAST({broken_sql('text')} AS INTEGER) AS broken FROM damaged")
def broken_glyphs(spark, sf):
    return damaged(spark, sf).select("doc_id", se.broken_glyphs(F.col("text")).alias("broken"))


@query("flattened_table", f"WITH {DAMAGED} SELECT doc_id, {flat_sql('text')} AS flattened FROM damaged")
def flattened_table(spark, sf):
    return damaged(spark, sf).select("doc_id", se.flattened_table(F.col("text")).alias("flattened"))


@query("needs_recovery", f"""WITH {DAMAGED}, b AS (SELECT *, {strip_sql('text')} AS t FROM damaged)
SELECT doc_id, CASE WHEN {broken_sql('t')} > 0 OR {flat_sql('t')} THEN true WHEN NOT has_images THEN false ELSE length(t) < 800 END AS recover FROM b""")
def needs_recovery(spark, sf):
    return damaged(spark, sf).select("doc_id", se.needs_recovery(F.col("text"), F.col("has_images")).alias("recover"))


@query("merge_recovered_text", f"""WITH {DAMAGED}, r AS (SELECT doc_id, {strip_sql('text')} AS rec FROM documents WHERE length(source) = 5 AND length({strip_sql('text')}) >= 150),
j AS (SELECT d.doc_id, {strip_sql('d.text')} AS t, rec FROM damaged d LEFT JOIN r USING (doc_id))
SELECT doc_id, CASE WHEN rec IS NULL THEN 'kept' WHEN {broken_sql('t')} > 0 AND {broken_sql('rec')} = 0 THEN 'replaced' ELSE 'appended' END AS how,
  sha256(CASE WHEN rec IS NULL THEN t WHEN {broken_sql('t')} > 0 AND {broken_sql('rec')} = 0 THEN rec ELSE concat_ws({NL} || {NL}, nullif(t, ''), rec) END) AS digest FROM j""")
def merge_recovered_text(spark, sf):
    fresh = table(spark, sf, "documents").filter(F.length("source") == 5).select("doc_id", F.col("text").alias("recovered"))
    out = se.merge_recovered_text(damaged(spark, sf), fresh, ["doc_id"])
    return out.select("doc_id", "how", F.sha2("text", 256).alias("digest"))


# ---------------------------------------------------------------- chunking


def packed_sql(src, key, limit, overlap=0, window=None, name="pk"):
    """Recursive CTEs up to ``<name>(key, part, text)``: paragraphs of (key, text) packed up to a limit.

    The text of the open piece is carried along, so the overlap is its end.
    """
    step = f"greatest({limit} - {window if window is not None else ck.WINDOW_OVERLAP}, 1)"
    nn = f"{NL} || {NL}"
    big = f"length(p.t) > {limit}"
    tail = f"CASE WHEN {overlap} > 0 THEN right(r.cur, {overlap}) || {nn} || p.t ELSE p.t END"
    tail_n = f"CASE WHEN {overlap} > 0 THEN length(right(r.cur, {overlap})) + length(p.t) + 2 ELSE length(p.t) END"
    flush = f"r.cur IS NOT NULL AND ({big} OR r.used + length(p.t) + 2 > {limit})"
    return f"""
{name}_p AS (SELECT {key} AS k, {limit} AS lim, unnest(ps) AS t, generate_subscripts(ps, 1) AS i FROM (SELECT *, {paragraphs_sql('text')} AS ps FROM {src})),
{name}_r AS (
  SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS cur, 0 AS used, CAST(NULL AS VARCHAR) AS out, CAST(NULL AS VARCHAR) AS big FROM {name}_p WHERE i = 1
  UNION ALL
  SELECT r.k, p.i, CASE WHEN {big.replace(str(limit), 'p.lim')} THEN NULL WHEN r.cur IS NULL THEN p.t WHEN r.used + length(p.t) + 2 > p.lim THEN {tail} ELSE r.cur || {nn} || p.t END,
    CASE WHEN {big.replace(str(limit), 'p.lim')} THEN 0 WHEN r.cur IS NULL THEN length(p.t) + 2 WHEN r.used + length(p.t) + 2 > p.lim THEN {tail_n} ELSE r.used + length(p.t) + 2 END,
    CASE WHEN {flush.replace(str(limit), 'p.lim')} THEN r.cur END, CASE WHEN {big.replace(str(limit), 'p.lim')} THEN p.t END
  FROM {name}_r r JOIN {name}_p p ON p.k = r.k AND p.i = r.i + 1),
{name}_o AS (
  SELECT k, i, 0 AS s, 0 AS w, out AS text FROM {name}_r WHERE out IS NOT NULL
  UNION ALL SELECT k, i, 1, w0, substr(big, w0 + 1, lim) FROM (SELECT k, i, big, lim, unnest(range(0, length(big), {step.replace(str(limit), 'lim')})) AS w0 FROM {name}_r JOIN (SELECT DISTINCT k, lim FROM {name}_p) USING (k) WHERE big IS NOT NULL)
  UNION ALL SELECT k, i + 1, 2, 0, cur FROM {name}_r r WHERE cur IS NOT NULL AND i = (SELECT max(i) FROM {name}_p p WHERE p.k = r.k)),
{name} AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i, s, w) AS part, text FROM {name}_o
           UNION ALL SELECT {key}, 1, left(text, {limit}) FROM {src} WHERE len({paragraphs_sql('text')}) = 0)"""


def _parts(df, key="doc_id"):
    out = df.select(key, F.posexplode_outer("parts").alias("part", "chunk"))
    return out.select(key, (F.col("part") + 1).alias("part"), F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("digest"))


_PARTS = "SELECT k AS doc_id, CAST(part AS INTEGER) AS part, CAST(length(text) AS INTEGER) AS chars, sha256(text) AS digest FROM pk"


@query("paragraph_chunks", f"WITH RECURSIVE {SPACED}, {packed_sql('(SELECT * FROM spaced WHERE length(text) > 0)', 'doc_id', 1200, 200, 200)} {_PARTS}")
def paragraph_chunks(spark, sf):
    return _parts(ck.paragraph_chunks(spaced(spark, sf), "text"))


@query("sliding_windows", """SELECT doc_id, CAST(w0 // 450 AS INTEGER) AS window_no, CAST(length(substr(text, w0 + 1, 500)) AS INTEGER) AS chars, sha256(substr(text, w0 + 1, 500)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS w0 FROM documents WHERE length(text) > 0)""")
def sliding_windows(spark, sf):
    out = ck.sliding_windows(table(spark, sf, "documents").select("doc_id", "text"), "text", 500, 50)
    return out.select("doc_id", "window_no", F.length("window").alias("chars"), F.sha2("window", 256).alias("digest"))


@query("split_text", f"WITH RECURSIVE {SPACED}, {packed_sql('spaced', 'doc_id', 800)} {_PARTS}")
def split_text(spark, sf):
    return _parts(ck.split_text(spaced(spark, sf), "text", F.lit(800)))


_PIPE = quoted(ck.PIPE_ROW)
_filled = f"list_filter(regexp_split_to_array(b, {BREAK_SQL}), lambda l: {strip_sql('l')} <> '')"


def order_tables(spark, sf):
    return se.markdown_table(order_rows(spark, sf), ["doc_id"]).withColumnRenamed("table", "text")


# Tables with a line of prose in front for the orders of urgent priority.
def order_blocks(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    prose = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Items\nof the order\n")).otherwise(F.lit(""))
    return order_tables(spark, sf).join(o, "doc_id").select("doc_id", F.concat(prose, "text").alias("text"))


ORDER_BLOCKS = f"""{ORDER_ROWS}, oblk AS (SELECT doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Items' || {NL} || 'of the order' || {NL} ELSE '' END || {pipe_sql('rows')} AS b
  FROM otab JOIN orders ON o_orderkey = doc_id)"""


@query("is_markdown_table", f"""WITH {ORDER_BLOCKS} SELECT doc_id, len({_filled}) >= 3 AND len(list_filter({_filled}, lambda l: regexp_matches(l, {_PIPE}))) >= len({_filled}) * 8e-1 AS is_table FROM oblk""")
def is_markdown_table(spark, sf):
    return order_blocks(spark, sf).select("doc_id", ck.is_markdown_table(F.col("text")).alias("is_table"))


@query("split_table_rows", f"""WITH RECURSIVE {ORDER_BLOCKS},
f AS (SELECT doc_id, b, {_filled} AS a FROM oblk),
h AS (SELECT *, CASE WHEN regexp_matches(coalesce(a[2], ''), {_PIPE}) THEN 2 ELSE least(3, len(a)) END AS hn FROM f),
g AS (SELECT *, array_to_string(a[1:hn], {NL}) AS head FROM h),
body AS (SELECT doc_id, head, unnest(a[hn + 1:]) AS l, generate_subscripts(a[hn + 1:], 1) AS i FROM g),
r AS (SELECT doc_id, i, 1 AS grp, length(head) + 1 + length(l) + 1 AS used FROM body WHERE i = 1
      UNION ALL SELECT r.doc_id, b.i, CASE WHEN r.used + length(l) + 1 > 90 THEN grp + 1 ELSE grp END, CASE WHEN r.used + length(l) + 1 > 90 THEN length(head) + 1 + length(l) + 1 ELSE r.used + length(l) + 1 END
      FROM r JOIN body b ON b.doc_id = r.doc_id AND b.i = r.i + 1),
o AS (SELECT doc_id, grp AS part, any_value(head) || {NL} || string_agg(l, {NL} ORDER BY i) AS t FROM r JOIN body USING (doc_id, i) GROUP BY 1, 2
      UNION ALL SELECT doc_id, 1, b FROM g WHERE len(a) <= hn)
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS digest FROM o""")
def split_table_rows(spark, sf):
    return _parts(ck.split_table_rows(order_blocks(spark, sf), "text", F.lit(90)))


FORMATS = {"en": "pptx", "de": "pdf", "fr": "xlsx"}


def format_of(lang):
    out = F.lit("unknown")
    for k, v in FORMATS.items():
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def format_sql(lang):
    return f"CASE {lang} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMATS.items()) + " ELSE 'unknown' END"


def limits_sql(fmt):
    merge = " ".join(f"WHEN '{n}' THEN {m}" for n, m, _ in ck.SIZE_THRESHOLDS)
    split = " ".join(f"WHEN '{n}' THEN {s}" for n, _, s in ck.SIZE_THRESHOLDS)
    return f"CASE {fmt} {merge} ELSE 200 END", f"CASE {fmt} {split} ELSE 1200 END"


@query("size_thresholds", f"SELECT doc_id, {format_sql('lang')} AS doc_format, {limits_sql(format_sql('lang'))[0]} AS merge_below, {limits_sql(format_sql('lang'))[1]} AS split_above FROM documents")
def size_thresholds(spark, sf):
    fmt = format_of(F.col("lang"))
    merge, split = ck.size_thresholds(fmt)
    return table(spark, sf, "documents").select("doc_id", fmt.alias("doc_format"), merge.alias("merge_below"), split.alias("split_above"))


def units(spark, sf):
    """Sections of the spaced documents; the table of the order with the document's id follows them.

    Written once, as an ingest would keep them: two branches of the scan read them.
    """
    return staged(spark, "units", [source(sf, t) for t in ("documents", "lineitem", "orders")], lambda: _units(spark, sf))


def _units(spark, sf):
    fmt = table(spark, sf, "documents").select("doc_id", format_of(F.col("lang")).alias("doc_format"))
    none = F.lit(None).cast("int")
    secs = se.text_sections(spaced(spark, sf), "doc_id", "text")
    secs = secs.select("doc_id", F.col("unit_index").cast("long").alias("pos"), "unit_index", "unit_type", "title", "section_path", "text",
                       F.lit(False).alias("is_table"), none.alias("table_index"), none.alias("parent_page_index"))
    rows = order_rows(spark, sf).join(fmt.select("doc_id"), "doc_id", "left_semi")
    tabs = se.markdown_table(rows, ["doc_id"]).withColumnRenamed("table", "text").select(
        "doc_id", F.lit(1000000).cast("long").alias("pos"), F.lit(10001).alias("unit_index"), F.lit("table").alias("unit_type"), F.lit("items").alias("title"),
        F.lit("").alias("section_path"), "text", F.lit(True).alias("is_table"), F.lit(1).alias("table_index"), F.lit(1).alias("parent_page_index"))
    return secs.unionByName(tabs).join(fmt, "doc_id")


_merge, _split = limits_sql("fmt")
_SECS = SECTIONS.replace("FROM marked", "FROM spaced")
UNITS = f"""{SPACED}, {ORDER_ROWS}, {LINES.replace('FROM marked', 'FROM spaced')}, {MARKS}, {DOC_TITLE}, {_SECS},
un AS (SELECT s.doc_id, CAST(unit_index AS BIGINT) AS pos, unit_index, 'section' AS unit_type, title, section_path, text, false AS is_table FROM sections s
       UNION ALL SELECT doc_id, 1000000, 10001, 'table', 'items', '', {pipe_sql('rows')}, true FROM otab JOIN documents USING (doc_id)),
uf AS (SELECT u.*, {format_sql('lang')} AS fmt, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM un u JOIN documents USING (doc_id)),
ul AS (SELECT *, {_merge} AS mb, {_split} AS sa, length(text) AS n FROM uf)"""

# The state of the open group of short units: its number, size and joined length, its path.
ADAPTIVE = f"""
st AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, 0 AS grp, 0 AS cnt, 0 AS tot, 0 AS jl, CAST(NULL AS VARCHAR) AS path, CAST(0 AS INTEGER) AS mine, CAST(NULL AS VARCHAR) AS role FROM ul WHERE i = 1
  UNION ALL
  SELECT s.doc_id, u.i,
    CASE WHEN u.role = 'short' THEN s.grp + (CASE WHEN s.cnt > 0 AND s.path <> u.section_path THEN 1 ELSE 0 END) + (CASE WHEN (CASE WHEN s.cnt > 0 AND s.path <> u.section_path THEN 0 ELSE s.tot END) + u.n >= u.mb THEN 1 ELSE 0 END)
         WHEN u.role = 'fit' AND s.cnt > 0 AND s.jl + 2 + u.n <= u.sa THEN s.grp + 1
         ELSE s.grp + (CASE WHEN s.cnt > 0 THEN 2 ELSE 1 END) END,
    CASE WHEN u.role <> 'short' THEN 0 WHEN (CASE WHEN s.cnt > 0 AND s.path <> u.section_path THEN 0 ELSE s.tot END) + u.n >= u.mb THEN 0 WHEN s.cnt > 0 AND s.path <> u.section_path THEN 1 ELSE s.cnt + 1 END,
    CASE WHEN u.role <> 'short' THEN 0 WHEN (CASE WHEN s.cnt > 0 AND s.path <> u.section_path THEN 0 ELSE s.tot END) + u.n >= u.mb THEN 0 WHEN s.cnt > 0 AND s.path <> u.section_path THEN u.n ELSE s.tot + u.n END,
    CASE WHEN u.role <> 'short' THEN 0 WHEN s.cnt > 0 AND s.path = u.section_path THEN s.jl + 2 + u.n ELSE u.n END,
    u.section_path,
    CASE WHEN u.role = 'short' THEN s.grp + (CASE WHEN s.cnt > 0 AND s.path <> u.section_path THEN 1 ELSE 0 END)
         WHEN u.role = 'fit' AND s.cnt > 0 AND s.jl + 2 + u.n <= u.sa THEN s.grp
         ELSE s.grp + (CASE WHEN s.cnt > 0 THEN 1 ELSE 0 END) END, u.role
  FROM st s JOIN (SELECT *, CASE WHEN is_table AND n > sa THEN 'split' WHEN is_table THEN 'table' WHEN n > sa THEN 'split' WHEN n < mb THEN 'short' ELSE 'fit' END AS role FROM ul) u
    ON u.doc_id = s.doc_id AND u.i = s.i + 1),
gr AS (SELECT u.*, s.mine, s.role FROM ul u JOIN st s USING (doc_id, i)),
ch AS (SELECT doc_id, mine, any_value(fmt) AS fmt, any_value(sa) AS sa, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS members, max(role) FILTER (role <> 'short') AS whole_role,
         arg_min(unit_index, pos) AS unit_index, arg_max(unit_type, pos) AS unit_type, arg_max(section_path, pos) AS section_path, bool_or(is_table) AS is_table,
         CASE WHEN count(*) = 1 THEN any_value(title)
              WHEN bool_or(role = 'fit') THEN coalesce(nullif(max(title) FILTER (role = 'fit'), ''), arg_min(title, pos) FILTER (role = 'short' AND title <> ''), '')
              ELSE coalesce(string_agg(title, ' + ' ORDER BY pos) FILTER (title <> ''), '') END AS title,
         string_agg(text, {NL} || {NL} ORDER BY pos) AS text, string_agg(CAST(unit_index AS VARCHAR), ',' ORDER BY pos) FILTER (role = 'short') AS shorts
       FROM gr GROUP BY doc_id, mine),
big AS (SELECT doc_id * 1000000 + mine AS key, text, sa FROM ch WHERE whole_role = 'split')"""

_hd = f"array_to_string(list_distinct_kept, ' / ')"


@query("adaptive_chunk", f"""WITH RECURSIVE {UNITS}, {ADAPTIVE}, {packed_sql('big', 'key', 'sa')},
hd AS (SELECT *, CASE WHEN {strip_sql('section_path')} = '' THEN {strip_sql('title')} WHEN {strip_sql('title')} = '' OR {strip_sql('title')} = {strip_sql('section_path')} THEN {strip_sql('section_path')}
         ELSE {strip_sql('section_path')} || ' / ' || {strip_sql('title')} END AS header FROM ch),
fl AS (SELECT h.* EXCLUDE (text), coalesce(p.part, 1) AS part, CASE WHEN whole_role = 'split' THEN p.text ELSE h.text END AS frag, count(*) OVER (PARTITION BY doc_id, mine) AS parts
       FROM hd h LEFT JOIN pk p ON h.whole_role = 'split' AND p.k = h.doc_id * 1000000 + h.mine)
SELECT doc_id, fmt AS doc_format, CAST(part AS INTEGER) AS part_no, CAST(unit_index AS INTEGER) AS unit_index, unit_type, is_table,
  CASE WHEN whole_role = 'split' AND parts > 1 THEN title || ' (part ' || part || '/' || parts || ')' ELSE title END AS title, section_path,
  CASE WHEN members > 1 AND coalesce(whole_role, '') <> 'fit' THEN shorts ELSE '' END AS merged, CASE WHEN members > 1 AND whole_role = 'fit' THEN shorts ELSE '' END AS absorbed,
  CASE WHEN whole_role = 'split' THEN part || '/' || parts END AS split_part,
  sha256(CASE WHEN whole_role = 'split' AND NOT is_table AND header <> '' AND NOT contains(left(frag, length(header) + 120), header)
    AND {strip_sql(f"string_split(ltrim(frag, {WS_SQL}), {NL})[1]")} <> header THEN header || {NL} || {NL} || frag ELSE frag END) AS digest
FROM fl""")
def adaptive_chunk(spark, sf):
    out = ck.adaptive_chunk(units(spark, sf))
    return out.select(
        "doc_id", "doc_format", "part_no", "unit_index", "unit_type", "is_table", "title", "section_path",
        F.array_join("merged_units", ",").alias("merged"), F.array_join("absorbed_units", ",").alias("absorbed"), "split_part", F.sha2("text", 256).alias("digest"),
    )


@query("inherit_context", f"""WITH {MARKED}, {LINES}, {MARKS}, {DOC_TITLE}, {SECTIONS},
h AS (SELECT *, CASE WHEN {strip_sql('section_path')} = '' THEN {strip_sql('title')} WHEN {strip_sql('title')} = '' OR {strip_sql('title')} = {strip_sql('section_path')} THEN {strip_sql('section_path')}
        ELSE {strip_sql('section_path')} || ' / ' || {strip_sql('title')} END AS header, text AS frag FROM sections)
SELECT doc_id, unit_index, header, CASE WHEN header = '' OR contains(left(frag, length(header) + 120), header) OR {strip_sql(f"string_split(ltrim(frag, {WS_SQL}), {NL})[1]")} = header
  THEN frag ELSE header || {NL} || {NL} || frag END AS text FROM h""")
def inherit_context(spark, sf):
    secs = se.text_sections(marked(spark, sf), "doc_id", "text")
    header = ck.context_header(F.col("section_path"), F.col("title"))
    frag = F.col("text")
    return secs.select("doc_id", "unit_index", header.alias("header"), ck.with_header(frag, header).alias("text"))


# ---------------------------------------------------------------- tagging

_ascii = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{N}\\p{M}]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g')"


def entities_sql(text):
    """Entity list of a text; letters beyond ASCII stand as a plain letter where word borders count."""
    plain = _ascii.replace("(text,", f"({text},")
    pats = {k: v.replace("(?U)", "").replace("(?Uiu)", "(?i)") for k, v in tg.ENTITY_PATTERNS.items()}
    found = [f"regexp_extract_all({text if k == 'quoted' else plain}, {quoted(p)}, 1)" for k, p in pats.items()]
    words = "[" + ", ".join(quoted(k.lower()) for k in tg.KEYWORDS) + "]"
    named = f"list_filter({words}, lambda k: contains(lower({text}), k))"
    clean = f"list_filter(list_transform(list_concat({', '.join(found)}), lambda v: {strip_sql(f'lower({strip_sql('v')})')}), lambda v: v <> '' AND length(v) <= {tg.ENTITY_CHARS})"
    return f"list_sort(list_distinct(list_concat({named}, {clean})))[1:{tg.ENTITY_COUNT}]"


@query("extract_entities", f"SELECT doc_id, array_to_string({entities_sql('text')}, ' | ') AS entities FROM documents")
def extract_entities(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tg.extract_entities(F.col("text")), " | ").alias("entities"))


_ID_SQL = """'file::' || doc_id || '::page_' || CASE WHEN is_table AND coalesce(parent, 0) <> 0 THEN parent ELSE unit_index END
  || CASE WHEN is_table THEN '::table_' || coalesce(CAST(table_index AS VARCHAR), 'None') ELSE '' END || CASE WHEN coalesce(split_part, '') <> '' THEN '::part_' || replace(split_part, '/', 'of') ELSE '' END"""
_LINE_CHUNKS = """lc AS (SELECT l_orderkey AS doc_id, l_linenumber AS unit_index, l_returnflag = 'R' AS is_table, l_suppkey AS table_index, l_linenumber % 3 AS parent,
  CASE WHEN l_linestatus = 'O' THEN l_linenumber || '/7' END AS split_part FROM lineitem)"""


def line_chunks(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), n.alias("unit_index"), (F.col("l_returnflag") == "R").alias("is_table"), F.col("l_suppkey").alias("table_index"),
        (n % 3).alias("parent_page_index"), F.when(F.col("l_linestatus") == "O", F.concat(n.cast("string"), F.lit("/7"))).alias("split_part"),
    )


@query("chunk_ids", f"WITH {_LINE_CHUNKS}, ids AS (SELECT {_ID_SQL} AS chunk_id FROM lc) SELECT chunk_id, count(*) AS n FROM ids GROUP BY 1 HAVING count(*) > 1")
def chunk_ids(spark, sf):
    return tg.repeated_ids(tg.with_chunk_ids(line_chunks(spark, sf)))


@query("tag_chunks", f"""WITH {MARKED}, {LINES}, {MARKS}, {DOC_TITLE}, {SECTIONS}, topics AS (SELECT doc_id, lang || '-' || source AS doc_topic, text AS doc_summary FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT s.doc_id, 'file::' || s.doc_id || '::page_' || unit_index AS chunk_id, unit_index, CAST(length(text) AS INTEGER) AS char_count, CASE WHEN title <> '' THEN title ELSE CAST(s.doc_id AS VARCHAR) END AS display_title,
  array_to_string({entities_sql('text')}, ' | ') AS entities, coalesce(doc_topic, 'general') AS doc_topic, coalesce(doc_summary, '') AS doc_summary FROM sections s LEFT JOIN topics t ON t.doc_id = s.doc_id""")
def tag_chunks(spark, sf):
    secs = se.text_sections(marked(spark, sf), "doc_id", "text")
    secs = secs.withColumn("is_table", F.lit(False)).withColumn("split_part", F.lit(None).cast("string"))
    secs = secs.withColumn("table_index", F.lit(None).cast("int")).withColumn("parent_page_index", F.lit(None).cast("int"))
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id")
    attrs = docs.select("doc_id", F.concat("lang", F.lit("-"), "source").alias("doc_topic"), F.col("text").alias("doc_summary"))
    out = tg.tag_chunks(secs, attrs)
    return out.select("doc_id", "chunk_id", "unit_index", "char_count", "display_title", F.array_join("entities", " | ").alias("entities"), "doc_topic", "doc_summary")


@query("chunk_metadata", f"""WITH {MARKED}, {LINES}, {MARKS}, {DOC_TITLE}, {SECTIONS}, topics AS (SELECT doc_id, lang || '-' || source AS doc_topic, text AS doc_summary FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
v AS (SELECT s.*, lang, {entities_sql('text')} AS ents FROM sections s JOIN (SELECT doc_id, lang FROM documents) d ON d.doc_id = s.doc_id)
SELECT 'file::' || v.doc_id || '::page_' || unit_index AS chunk_id, concat_ws(chr(31), 'doc_id=' || v.doc_id, CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END, unit_index, 'section', title, section_path, 'false', CAST(length(text) AS INTEGER),
  array_to_string(ents, ' '), coalesce(doc_topic, 'general'), coalesce(doc_summary, ''), CASE WHEN doc_topic IS NULL THEN '' ELSE doc_topic || ', ' || lang END,
  CASE WHEN title <> '' THEN title ELSE CAST(v.doc_id AS VARCHAR) END, v.doc_id, 'file') AS metadata FROM v LEFT JOIN topics t ON t.doc_id = v.doc_id""")
def chunk_metadata(spark, sf):
    """All keys of every section; the values in the order of the keys."""
    secs = se.text_sections(marked(spark, sf), "doc_id", "text")
    secs = secs.withColumn("is_table", F.lit(False)).withColumn("split_part", F.lit(None).cast("string"))
    secs = secs.withColumn("table_index", F.lit(None).cast("int")).withColumn("parent_page_index", F.lit(None).cast("int"))
    docs = table(spark, sf, "documents")
    secs = secs.join(docs.select("doc_id", F.when(F.col("lang") == "en", ".md").otherwise(".txt").alias("doc_format")), "doc_id")
    topic = F.concat("lang", F.lit("-"), "source")
    attrs = docs.join(table(spark, sf, "labels").filter("quality = 1"), "doc_id").select("doc_id", topic.alias("doc_topic"), F.col("text").alias("doc_summary"), F.array(topic, F.col("lang")).alias("key_terms"))
    out = tg.chunk_metadata(tg.tag_chunks(secs, attrs))
    return out.select("chunk_id", F.concat(F.lit("doc_id="), F.array_join(F.map_values("metadata"), "\x1f")).alias("metadata"))


@query("drop_empty_metadata", """SELECT doc_id, concat_ws(',', 'lang', CASE WHEN quality = 1 THEN 'quality' END, 'source', CASE WHEN toxic IS NOT NULL THEN 'toxic' END) AS kept
FROM documents LEFT JOIN labels USING (doc_id)""")
def drop_empty_metadata(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    attrs = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("quality"), F.when(F.col("quality") == 1, F.lit("[1]")).otherwise(F.lit("[]")),
        F.lit("source"), F.col("source"), F.lit("toxic"), F.col("toxic").cast("string"),
    )
    return df.select("doc_id", F.array_join(F.map_keys(tg.drop_empty_metadata(attrs)), ",").alias("kept"))


@query("doc_snippet", f"""WITH {MARKED}, {LINES}, {MARKS}, {DOC_TITLE}, {SECTIONS}
SELECT source AS doc_id, left(string_agg(s.text, {NL} || {NL} ORDER BY s.doc_id * 100000 + unit_index), 5000) AS snippet FROM sections s JOIN documents d USING (doc_id) WHERE length(s.text) > 0 GROUP BY source""")
def doc_snippet(spark, sf):
    secs = se.text_sections(marked(spark, sf), "doc_id", "text").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    pos = F.col("doc_id") * 100000 + F.col("unit_index")
    return tg.doc_snippet(secs.select(F.col("source").alias("doc_id"), pos.alias("pos"), "text"))


@query("normalize_topic", f"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower({strip_sql(f"string_split({strip_sql('text')}, {NL})[1]")}), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_-') AS n FROM documents)
SELECT doc_id, CASE WHEN n <> '' AND length(n) <= 40 THEN n ELSE 'general' END AS topic FROM t""")
def normalize_topic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tg.normalize_topic(F.col("text")).alias("topic"))


def verdicts(spark, sf):
    """Summary verdicts as JSON text: fenced, bare or broken, by language."""
    js = F.to_json(F.struct(F.col("text").alias("summary"), F.split("text", " ").alias("key_terms")))
    raw = F.when(F.col("lang") == "en", F.concat(F.lit("```json\n"), js, F.lit("\n```"))).when(F.col("lang") == "de", js).otherwise(F.concat(F.lit("no "), js))
    return table(spark, sf, "documents").select("doc_id", "lang", "source", raw.alias("raw"))


@query("parse_doc_summary", f"""WITH p AS (SELECT doc_id, lang IN ('en', 'de') AS good, left({strip_sql('text')}, 300) AS s,
  list_filter(list_transform(string_split(text, ' '), lambda t: {strip_sql('t')}), lambda t: t <> '')[1:10] AS k FROM documents)
SELECT doc_id, CASE WHEN good THEN s ELSE '' END AS summary, CASE WHEN good THEN array_to_string(k, '|') ELSE '' END AS key_terms FROM p""")
def parse_doc_summary(spark, sf):
    parsed = tg.parse_doc_summary(F.col("raw"))
    return verdicts(spark, sf).select("doc_id", parsed["summary"].alias("summary"), F.array_join(parsed["key_terms"], "|").alias("key_terms"))


@query("doc_catalog", f"""WITH f AS (SELECT source, arg_min(lang, doc_id) AS lang, arg_min(text, doc_id) AS text FROM documents GROUP BY source)
SELECT source AS doc_id, '- [' || source || ']' || {NL} || '  요약: ' || {strip_sql('text')} || {NL} || '  관련 어휘: ' || lang AS entry FROM f WHERE lang <> 'de' AND {strip_sql('text')} <> ''""")
def doc_catalog(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("pos"), F.when(F.col("lang") != "de", F.col("text")).alias("doc_summary"), F.col("lang").alias("key_terms"))
    return tg.doc_catalog(docs)


@query("corpus_stats", f"""WITH {MARKED}, {LINES}, {MARKS}, {DOC_TITLE}, {SECTIONS}, c AS (SELECT lang, length(s.text) AS n FROM sections s JOIN documents USING (doc_id))
SELECT lang, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS chars, count(*) FILTER (n < 100) AS short_chunks, round(avg(CASE WHEN n < 100 THEN 1e0 ELSE 0e0 END), 6) AS short_share,
  CAST(min(n) AS INTEGER) AS smallest, CAST(max(n) AS INTEGER) AS largest, quantile_cont(CAST(n AS DOUBLE), 5e-1) AS median, round(quantile_cont(CAST(n AS DOUBLE), 95e-2), 6) AS p95 FROM c GROUP BY lang""")
def corpus_stats(spark, sf):
    secs = se.text_sections(marked(spark, sf), "doc_id", "text").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return tg.corpus_stats(secs, ["lang"]).withColumn("p95", F.round("p95", 6))


# ---------------------------------------------------------------- ingest as one job: fingerprints, diff, sections, ids, a new version


@query("ingest_documents", f"""WITH {MARKED}, {LINES}, {MARKS}, {DOC_TITLE}, {SECTIONS}
SELECT CAST(doc_id AS VARCHAR) AS path, 'file::' || doc_id || '::page_' || unit_index AS chunk_id, sha256(text) AS digest FROM sections WHERE doc_id % 3 <> 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'old::' || doc_id, 'kept' FROM documents WHERE doc_id % 3 = 0""")
def ingest_documents(spark, sf):
    """A third of the documents is known with its hash, a third with another hash, a third is new; some known paths are gone."""
    docs = marked(spark, sf).withColumn("path", F.col("doc_id").cast("string"))
    hashed = docs.select("doc_id", "path", fi.content_fingerprint(F.col("text").cast("binary")).alias("hash"))
    snapshot = hashed.select("path", "hash")
    known = hashed.filter(F.col("doc_id") % 3 < 2).select("path", F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise("other").alias("hash"))
    gone = hashed.filter(F.col("doc_id") % 10 == 0).select(F.concat(F.lit("gone-"), "path").alias("path"), F.lit("x").alias("hash"))
    state = known.unionByName(gone)
    before = state.select("path", F.concat(F.lit("old::"), "path").alias("chunk_id"), F.lit("kept").alias("digest"))

    diff = ing.ingest_diff(snapshot, state)
    touched = diff.filter(F.col("status").isin("new", "updated")).select("path")
    secs = se.text_sections(docs.join(touched, "path", "left_semi"), "doc_id", "text")
    secs = secs.withColumn("is_table", F.lit(False)).withColumn("split_part", F.lit(None).cast("string"))
    secs = secs.withColumn("table_index", F.lit(None).cast("int")).withColumn("parent_page_index", F.lit(None).cast("int"))
    fresh = tg.tag_chunks(secs).select(F.col("doc_id").cast("string").alias("path"), "chunk_id", F.sha2("text", 256).alias("digest"))
    path = ing.write_version(ing.ingest_chunks(before, diff, fresh), fresh_path(spark, "corpus"), 2)
    return spark.read.parquet(path)
