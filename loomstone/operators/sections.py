"""From lines, pages, shapes and cells to the units of a document.

A text that arrives in one row is cut inside that row with array functions, so
sectioning needs no shuffle. Tables of pages, shapes or paragraphs, where one
document may hold any share of the rows, are carried forward in segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.ordered import position_bucket, scan

# Heading marks, page furniture, section heads, damage signs and limits.
MD_HEADING = f"(?s)^(#{{1,3}}){tx.WS}+(.+)$"
MARK_HEADING = f"(?s)^[■▶●◆]{tx.WS}*(.+)$"
BRACKET_HEADING = r"^\[([^\]]+)\]$"
NUMBER_HEADING = f"(?s)^(\\p{{Nd}}+)\\.{tx.WS}+(.+)$"
PAGE_MARKER = f"(?is)^(?:[-–—]?{tx.WS}*\\p{{Nd}}{{1,4}}|page(?:_|{tx.WS})*\\p{{Nd}}+|p\\.?{tx.WS}*\\p{{Nd}}+|©.*|slide{tx.WS}*\\p{{Nd}}+)$"
SENTENCE_ENDS = ["다.", "요.", "음."]
SUBTITLE_MARKS = "#-–—•* "
SECTION_HEAD = (
    f"^(?:PART{tx.WS}*\\p{{Nd}}+|\\p{{Nd}}{{1,2}}\\.{tx.WS}+{tx.NOT_WS}[^\n]{{0,28}}|\\p{{Nd}}+-\\p{{Nd}}+{tx.WS}+{tx.NOT_WS}[^\n]{{0,28}})$"
)
PART_HEAD = f"^(PART{tx.WS}*\\p{{Nd}}+)\\b"
CID = r"\(cid:\p{Nd}+\)"
ODD_GLYPH = "[\ue000-\uf8ff\u3200-\u33ff\u3400-\u4dbf\u2e80-\u2fdf]"
DIGIT_RUN = r"\p{Nd}{6,}"
GLUED_BULLET = f"[●○◆▪■□▶►]{tx.NOT_WS}"
GLUED_CELL = "[가-힣][A-Z][a-z]{2,}"
TITLE_CHARS, NUMBER_TITLE_CHARS, DOC_TITLE_CHARS, SUBTITLE_CHARS = 120, 50, 60, 60
CLEAN_CHARS, RECOVERED_CHARS, FILE_CONTEXT_CHARS = 800, 150, 8000
SUB_MIN, SUB_MAX, SUB_COUNT = 20, 500, 3


def section_marker(line: Column) -> Column:
    """(kind, title) of a heading line, null for any other line."""

    def of(text: Column) -> Column:
        def title(pattern: str, group: int) -> Column:
            return tx.strip(F.regexp_extract(text, pattern, group))

        def found(kind: Column | str, name: Column) -> Column:
            kind = F.lit(kind) if isinstance(kind, str) else kind
            return F.struct(kind.alias("kind"), name.alias("title"))

        numbered = F.rlike(text, F.lit(NUMBER_HEADING)) & (F.length(title(NUMBER_HEADING, 2)) <= NUMBER_TITLE_CHARS)
        level = F.length(F.regexp_extract(text, MD_HEADING, 1)).cast("string")
        return (
            F.when(F.rlike(text, F.lit(MD_HEADING)), found(F.concat(F.lit("md_h"), level), title(MD_HEADING, 2)))
            .when(F.rlike(text, F.lit(MARK_HEADING)), found("marker", title(MARK_HEADING, 1)))
            .when(F.rlike(text, F.lit(BRACKET_HEADING)), found("bracket", title(BRACKET_HEADING, 1)))
            .when(numbered, found("num", title(NUMBER_HEADING, 2)))
        )

    return tx.let(tx.strip(line), of)


def detect_section_marker(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Heading lines of every text: (id, line_no, kind, title)."""
    rows = docs.select(id_col, F.posexplode(tx.lines(F.col(text_col))).alias("line_no", "line"))
    rows = rows.withColumn("m", section_marker(F.col("line"))).filter("m is not null")
    return rows.select(id_col, "line_no", "m.kind", "m.title")


def doc_title(line_array: Column) -> Column:
    """Title from the first five lines: the first that is a heading or at most 60 characters long."""
    named = F.transform(
        F.slice(line_array, 1, 5),
        lambda x: F.coalesce(
            section_marker(x)["title"], F.when((tx.strip(x) != "") & (F.length(tx.strip(x)) <= DOC_TITLE_CHARS), tx.strip(x))
        ),
    )
    return F.coalesce(F.get(F.filter(named, lambda t: t.isNotNull()), F.lit(0)), F.lit(""))


def guess_doc_title(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, tx.let(tx.lines(F.col(text_col)), doc_title).alias("title"))


def text_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Units of a text cut at its headings: (id, unit_index, unit_type, title, section_path, text)."""
    text = F.col(text_col)
    cut = docs.select(id_col, text_col, tx.lines(text).alias("_lines"))
    cut = cut.select("*", doc_title(F.col("_lines")).alias("_title"), F.transform("_lines", section_marker).alias("_marks"))
    heads = F.filter(
        F.transform("_marks", lambda m, i: F.struct(i.alias("at"), m["title"].alias("title"))), lambda h: h["title"].isNotNull()
    )
    start = F.array(F.struct(F.lit(-1).alias("at"), F.col("_title").alias("title")))
    cut = cut.withColumn("_heads", F.concat(start, heads))

    def section(h: Column, j: Column) -> Column:
        end = F.coalesce(F.get("_heads", j + 1)["at"], F.size("_lines"))
        body = F.array_join(F.slice("_lines", h["at"] + 2, end - h["at"] - 1), "\n")
        return F.struct(h["title"].alias("title"), tx.strip(body).alias("body"))

    cut = cut.withColumn("_sections", F.filter(F.transform("_heads", section), lambda s: s["body"] != ""))
    titled = F.transform(
        "_sections",
        lambda s: F.struct(
            s["title"].alias("title"),
            F.when(s["title"] != "", F.concat(F.lit("# "), s["title"], F.lit("\n\n"), s["body"])).otherwise(s["body"]).alias("text"),
        ),
    )
    whole = F.array(F.struct(F.col("_title").alias("title"), tx.strip(text).alias("text")))
    units = F.when(F.size("_sections") > 0, titled).when(~tx.blank(text), whole)
    out = cut.select(id_col, F.col("_title").alias("section_path"), F.posexplode_outer(units).alias("_at", "u")).filter("u is not null")
    return out.select(
        id_col, (F.col("_at") + 1).alias("unit_index"), F.lit("section").alias("unit_type"), "u.title", "section_path", "u.text"
    )


# ---------------------------------------------------------------- pages


def page_title(text: Column) -> Column:
    """The longer of the first line that is no page mark and the first heading with its subtitle lines."""

    def plain(rows: Column) -> Column:
        first = F.get(F.filter(F.slice(rows, 1, 4), lambda x: ~F.rlike(x, F.lit(PAGE_MARKER))), F.lit(0))
        sentence = F.lit(False)
        for end in SENTENCE_ENDS:
            sentence = sentence | F.endswith(first, F.lit(end))
        return F.when(~F.startswith(first, F.lit("#")) & ~sentence, first)

    def headed(rows: Column) -> Column:
        hash_ = F.lit("#")
        at = F.get(F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: F.startswith(F.get(rows, i - 1), hash_)), F.lit(0))

        def subtitle(i: Column) -> Column:
            raw = F.get(rows, i - 1)
            name = tx.strip(F.ltrim(raw, F.lit(SUBTITLE_MARKS)))
            bar = F.lit("|")
            usable = ~F.startswith(raw, bar) & (F.length(raw) <= SUBTITLE_CHARS) & (name != "") & ~F.startswith(name, bar)
            return F.when(usable, name)

        first, second = subtitle(at + 1), subtitle(at + 2)
        main = tx.strip(F.ltrim(F.get(rows, at - 1), hash_))
        return F.when(at.isNotNull(), F.concat_ws(" ", main, first, F.when(first.isNotNull(), second)))

    def best(rows: Column) -> Column:
        def fits(t: Column) -> Column:
            return F.when(F.length(t).between(2, TITLE_CHARS), t)

        def longer(pair: Column) -> Column:
            a, b = pair["a"], pair["b"]
            return F.when(a.isNull() | (F.length(b) > F.length(a)), F.coalesce(b, a, F.lit(""))).otherwise(a)

        return tx.let(F.struct(fits(plain(rows)).alias("a"), fits(headed(rows)).alias("b")), longer)

    return tx.let(tx.nonblank_lines(text), best)


def _nonempty(col: Column) -> Column:
    return F.when(col != "", col)


def carry_section(pages: DataFrame, head_chars: int = 300) -> DataFrame:
    """Section of each page of (doc_id, page, text): a head near its start, else that of the page before."""
    head = _nonempty(tx.strip(F.regexp_extract(F.left("text", F.lit(head_chars)), f"(?md)({SECTION_HEAD})", 1)))
    out = scan(pages, ["doc_id"], ["page"], position_bucket("page"), lasts={"section": head})
    return out.withColumn("section", F.coalesce("section", F.lit("")))


def carry_part(slides: DataFrame) -> DataFrame:
    """Part of each slide of (doc_id, slide, title, body): a part head in it, else that of the slide before."""
    head = _nonempty(F.regexp_extract(F.concat_ws("\n", "title", "body"), f"(?mdU){PART_HEAD}", 1))
    out = scan(slides, ["doc_id"], ["slide"], position_bucket("slide"), lasts={"part": head})
    return out.withColumn("part", F.coalesce("part", F.lit("")))


# ---------------------------------------------------------------- tables


def _has_text(cells: Column) -> Column:
    return F.exists(cells, lambda c: ~tx.blank(c))


def pipe_line(cells: Column, width: Column) -> Column:
    """One line of a Markdown table, padded to ``width`` cells."""

    def clean(c: Column) -> Column:
        return tx.strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))

    padded = F.concat(F.transform(cells, clean), F.array_repeat(F.lit(""), width - F.size(cells)))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def pipe_rule(width: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))


def pipe_table(rows: Column) -> Column:
    """Markdown table of an array of cell arrays; the first row is the header, short rows are padded."""

    def draw(width: Column) -> Column:
        lines = F.transform(rows, lambda r: pipe_line(r, width))
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(pipe_rule(width)), F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")

    width = F.array_max(F.transform(rows, F.size))
    return F.when(F.size(rows) > 0, F.when(width > 0, tx.let(width, draw)).otherwise(F.lit(""))).otherwise(F.lit(""))


def markdown_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One pipe table per key from (keys, row_no, cells)."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    return packed.select(*keys, pipe_table(F.transform("r", lambda x: x["cells"])).alias("table"))


def sheet_units(rows: DataFrame) -> DataFrame:
    """One unit per sheet of (doc_id, sheet_no, sheet, row_no, cells); rows without text are left out."""
    kept = rows.filter(_has_text(F.col("cells")))
    packed = kept.groupBy("doc_id", "sheet_no", "sheet").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    packed = packed.select("doc_id", "sheet_no", "sheet", F.transform("r", lambda x: x["cells"]).alias("cells"))
    return packed.select(
        "doc_id",
        F.col("sheet_no").alias("unit_index"),
        F.col("sheet").alias("title"),
        F.concat(F.lit("# 시트: "), "sheet", F.lit("\n\n"), pipe_table(F.col("cells"))).alias("text"),
        F.size("cells").alias("row_count"),
        F.array_max(F.transform("cells", F.size)).alias("col_count"),
    )


# ---------------------------------------------------------------- slides


def _slides(shapes: DataFrame) -> DataFrame:
    """One row per slide of (doc_id, slide, pos, kind, text, rows): title, bodies, tables, notes."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    kept_rows = F.filter("rows", _has_text)
    of = shapes.select("doc_id", "slide", "pos", "kind", text.alias("text"), F.when(F.size(kept_rows) > 0, kept_rows).alias("rows"))

    def ordered(kind: str, value: str) -> Column:
        picked = F.when((F.col("kind") == kind) & F.col(value).isNotNull() & (F.lit(value == "rows") | (F.col("text") != "")), F.struct("pos", value))
        return F.transform(F.array_sort(F.collect_list(picked)), lambda x: x[value])

    slides = of.groupBy("doc_id", "slide").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "title", F.col("text"))), F.lit("")).alias("title"),
        ordered("text", "text").alias("bodies"),
        ordered("table", "rows").alias("tables"),
        F.coalesce(F.max(F.when(F.col("kind") == "notes", F.col("text"))), F.lit("")).alias("notes"),
    )
    return slides.withColumn("body", F.array_join("bodies", "\n\n"))


def _slide_unit(index: Column, kind: str, title: Column, text: Column, table_index: Column, parent: Column) -> list[Column]:
    return [
        index.alias("unit_index"), F.lit(kind).alias("unit_type"), title.alias("title"), F.col("part").alias("section_path"),
        text.alias("text"), F.lit(kind == "table").alias("is_table"), table_index.alias("table_index"), parent.alias("parent_page_index"),
    ]


def slide_units(shapes: DataFrame) -> DataFrame:
    """Units of slides and, as units of their own, of their tables."""
    slides = carry_part(_slides(shapes))
    none = F.lit(None).cast("int")
    text = F.concat_ws("\n\n", F.when(F.col("title") != "", F.concat(F.lit("# "), "title")), _nonempty(F.col("body")))
    own = slides.filter((text != "") | (F.size("tables") > 0))
    own = own.select("doc_id", *_slide_unit(F.col("slide"), "slide", F.col("title"), text, none, none))
    tables = slides.select("*", F.posexplode("tables").alias("_t", "_rows")).withColumn("_t", F.col("_t") + 1)
    named = _numbered("표", F.col("_t"))
    tables = tables.select(
        "doc_id", *_slide_unit(F.col("slide") * 1000 + F.col("_t"), "table", named, pipe_table(F.col("_rows")), F.col("_t"), F.col("slide"))
    )
    return own.unionByName(tables)


def _numbered(word: str, n: Column) -> Column:
    n = n.cast("string")
    return F.when(F.col("title") != "", F.concat("title", F.lit(f" — {word} "), n)).otherwise(
        F.concat(F.lit("슬라이드 "), F.col("slide").cast("string"), F.lit(f" {word} "), n)
    )


def shape_subchunks(shapes: DataFrame) -> DataFrame:
    """Units of single shapes on slides that have at least three of middling length."""
    slides = carry_part(_slides(shapes))
    slides = slides.withColumn("_parts", F.filter("bodies", lambda b: F.length(b).between(SUB_MIN, SUB_MAX)))
    slides = slides.filter(F.size("_parts") >= SUB_COUNT)
    rows = slides.select("*", F.posexplode("_parts").alias("_i", "_text")).withColumn("_i", F.col("_i") + 1)
    return rows.select(
        "doc_id",
        *_slide_unit(F.col("slide") * 1000 + 100 + F.col("_i"), "slide_subchunk", _numbered("항목", F.col("_i")), F.col("_text"),
                     F.lit(None).cast("int"), F.col("slide")),
    )


def flat_document_text(shapes: DataFrame, chars: int = FILE_CONTEXT_CHARS) -> DataFrame:
    """Whole text of a slide file for questions about that file: (doc_id, full_chars, context)."""
    slides = _slides(shapes)
    pieces = F.concat(
        F.array(F.concat(F.lit("## 슬라이드 "), F.col("slide").cast("string"))),
        F.when(F.col("title") != "", F.array(F.concat(F.lit("### "), "title"))).otherwise(F.array().cast("array<string>")),
        "bodies",
        F.transform("tables", pipe_table),
        F.when(F.col("notes") != "", F.array(F.concat(F.lit("### 발표자 노트\n"), "notes"))).otherwise(F.array().cast("array<string>")),
    )
    slides = slides.select("doc_id", "slide", F.array_join(pieces, "\n\n").alias("block"))
    return _flat(slides.select("doc_id", F.col("slide").cast("long").alias("at"), F.lit(0).alias("line"), F.lit("\n\n").alias("gap"), "block"), chars)


def flat_sheet_text(rows: DataFrame, chars: int = FILE_CONTEXT_CHARS) -> DataFrame:
    """Whole text of a workbook of (doc_id, sheet_no, sheet, row_no, cells), sheet by sheet: (doc_id, full_chars, context).

    ``row_no`` is a number. Rows without text are left out, and so are sheets
    without such rows. Lines are made one by one, so a sheet may have any number
    of rows. A line travels drawn with its own cells, cut to ``chars``, and is
    padded where its place is known; only numbers and a title come from its sheet.
    """
    kept = rows.filter(_has_text(F.col("cells")) & F.col("doc_id").isNotNull() & F.col("sheet_no").isNotNull())
    lines = kept.select(
        "doc_id", F.col("sheet_no").cast("long").alias("at"), F.col("row_no").cast("long").alias("n"), "sheet", F.size("cells").alias("cells"),
        pipe_line(F.col("cells"), F.size("cells")).alias("text"),
    )
    # A line end and a line but for what its number of cells adds: three characters for each cell of the widest row.
    bare = (F.length("text") - 3 * F.col("cells") + 1).cast("long")
    # Numbers meet by hash; names, which need a sort, only once a sheet.
    named = lines.groupBy("doc_id", "at", "sheet").agg(F.max("cells").alias("width"), F.count("*").alias("count"), F.sum(bare).alias("bare"))
    sheets = named.groupBy("doc_id", "at").agg(
        F.max("width").cast("long").alias("width"), F.concat(F.lit("## 시트: "), F.min("sheet")).alias("title"), F.sum("count").alias("count"), F.sum("bare").alias("bare")
    )
    # What stands in a sheet beside its lines and line ends: gap, title and a second gap, and the rule.
    top = F.coalesce(F.length("title") + 3, F.lit(1)) + 4 * F.col("width") + 2
    sheets = sheets.select("doc_id", "at", "width", "title", top.alias("top"), (top + F.col("bare") + 3 * F.col("width") * F.col("count")).alias("all"))
    sheets = scan(sheets, ["doc_id"], ["at"], position_bucket("at"), sums={"end": F.col("all")}, levels=1)
    sized = lines.select("doc_id", "at", "n", "cells", bare.alias("bare"), F.left("text", F.lit(chars + 2)).alias("text"))
    placed = scan(sized, ["doc_id", "at"], ["n"], position_bucket("n"), sums={"upto": F.col("bare"), "nth": F.lit(1)}, levels=1).join(sheets, ["doc_id", "at"])
    is_head = F.col("nth") == 1
    before = F.col("end") - F.col("all")
    start = before + F.when(is_head, F.lit(0)).otherwise(F.col("top") + F.col("upto") - F.col("bare") + 3 * F.col("width") * (F.col("nth") - 1))
    padded = F.concat("text", F.repeat(F.lit("  |"), (F.col("width") - F.col("cells")).cast("int")))
    head = F.concat(F.when(before > 0, F.lit("\n\n")).otherwise(""), F.coalesce(F.concat("title", F.lit("\n\n")), F.lit("")), padded, F.lit("\n"), pipe_rule(F.col("width").cast("int")))
    piece = F.struct("at", "nth", F.left(F.when(is_head, head).otherwise(F.concat(F.lit("\n"), padded)), F.lit(chars + 2)).alias("text"))
    out = placed.groupBy("doc_id").agg((F.max("end") - 2).alias("full_chars"), F.array_sort(F.collect_list(F.when(start < chars + 2, piece))).alias("b"))
    return out.select("doc_id", "full_chars", F.left(F.array_join(F.transform("b", lambda x: x["text"]), ""), F.lit(chars)).alias("context"))


def flat_paragraph_text(items: DataFrame, chars: int = FILE_CONTEXT_CHARS) -> DataFrame:
    """Whole text of a paragraph file of (doc_id, pos, text, rows): its paragraphs, then its tables under their numbers.

    A row with ``rows`` is a table. Numbers run over all tables of a file, those
    without text too, which are left out themselves.
    """
    is_table = F.col("rows").isNotNull()
    numbered = scan(items.select("doc_id", "pos", "text", "rows"), ["doc_id"], ["pos"], position_bucket("pos"), sums={"no": is_table.cast("long")})
    text = tx.strip(F.coalesce("text", F.lit("")))
    kept = F.filter("rows", _has_text)
    drawn = F.concat(F.lit("## 표 "), F.col("no").cast("string"), F.lit("\n\n"), pipe_table(kept))
    block = F.when(~is_table & (text != ""), text).when(F.size(kept) > 0, drawn)
    made = numbered.select("doc_id", is_table.cast("long").alias("at"), F.col("pos").cast("long").alias("line"), F.lit("\n\n").alias("gap"), block.alias("block"))
    return _flat(made.filter("block IS NOT NULL"), chars)


def _flat(blocks: DataFrame, chars: int) -> DataFrame:
    """First ``chars`` of the blocks (doc_id, at, line, gap, block) of each document in order, and the length of all.

    ``gap`` stands before a block but for the first. Only blocks that start
    inside the kept length are gathered, and of each no more than that length;
    lengths tell the rest.
    """
    sized = blocks.withColumn("size", (F.length("gap") + F.length("block")).cast("long"))
    per_at = sized.groupBy("doc_id", "at").agg(F.sum("size").alias("all"))
    before = scan(per_at, ["doc_id"], ["at"], position_bucket("at"), sums={"upto": F.col("all")}, levels=1).select("doc_id", "at", (F.col("upto") - F.col("all")).alias("before"))
    inside = scan(sized, ["doc_id", "at"], ["line"], position_bucket("line"), sums={"upto": F.col("size")}, levels=1)
    placed = inside.join(before, ["doc_id", "at"]).withColumn("end", F.col("before") + F.col("upto"))
    starts = F.col("end") - F.col("size")
    piece = F.struct("at", "line", F.left(F.concat(F.when(starts > 0, F.col("gap")).otherwise(""), "block"), F.lit(chars + 2)).alias("text"))
    out = placed.groupBy("doc_id").agg(
        (F.max("end") - F.max(F.when(starts == 0, F.length("gap")))).alias("full_chars"), F.array_sort(F.collect_list(F.when(starts < chars + 2, piece))).alias("b")
    )
    return out.select("doc_id", "full_chars", F.left(F.array_join(F.transform("b", lambda x: x["text"]), ""), F.lit(chars)).alias("context"))


# ---------------------------------------------------------------- paragraphs with heading levels


_SECTION_UNITS = "array<struct<unit_index:bigint,unit_type:string,title:string,text:string,is_table:boolean,table_index:bigint,parent_page_index:bigint>>"


def heading_sections(items: DataFrame) -> DataFrame:
    """Units of (doc_id, pos, level, text, rows): paragraphs under headings, tables beside them.

    ``level`` is 0 for a plain paragraph; a row with ``rows`` is a table.
    """
    kept_rows = F.filter("rows", _has_text)
    # A table travels drawn, in the place of the text. Headings travel once, in the first row of their section.
    items = items.select("doc_id", "pos", "level", F.col("rows").isNotNull().alias("is_table"), F.size(kept_rows).alias("_n"),
                         F.when(F.col("rows").isNotNull(), pipe_table(kept_rows)).otherwise(tx.strip(F.coalesce("text", F.lit("")))).alias("text"))
    is_table = F.col("is_table")
    items = items.filter((is_table & (F.col("_n") > 0)) | (~is_table & (F.col("text") != ""))).drop("_n")
    head = ~is_table & F.col("level").isin(1, 2)
    numbered = scan(items, ["doc_id"], ["pos"], position_bucket("pos"), sums={"brk": head.cast("long"), "table_no": is_table.cast("long")})
    body = F.when(F.col("level") >= 3, F.concat(F.lit("### "), "text")).otherwise(F.col("text"))
    is_body = ~is_table & ~F.col("level").isin(1, 2)
    sections = numbered.groupBy("doc_id", "brk").agg(
        F.max(F.when(head & (F.col("level") == 1), F.col("text"))).alias("own1"), F.max(F.when(head & (F.col("level") == 2), F.col("text"))).alias("own2"),
        F.array_sort(F.collect_list(F.when(is_body, F.struct(F.col("pos"), body.alias("t"))))).alias("b"),
        F.array_sort(F.collect_list(F.when(is_table, F.struct("pos", "table_no", F.col("text").alias("t"))))).alias("tables"),
    )
    filled = (F.size("b") > 0).cast("long")
    under1 = F.when(F.col("own1").isNotNull(), F.lit(""))
    sections = scan(
        sections, ["doc_id"], ["brk"], position_bucket("brk"), sums={"index": filled}, lasts={"h1": F.col("own1"), "h2": F.coalesce(F.col("own2"), under1)}
    ).fillna({"h1": "", "h2": ""})
    path = F.concat_ws(" / ", _nonempty(F.col("h1")), _nonempty(F.col("h2")))
    title = F.coalesce(_nonempty(F.col("h2")), _nonempty(F.col("h1")))
    own_title = F.coalesce(title, F.concat(F.lit("섹션 "), F.col("index").cast("string")))
    none = F.lit(None).cast("long")
    own = F.struct(
        F.col("index").alias("unit_index"), F.lit("section").alias("unit_type"), own_title.alias("title"),
        F.concat(F.lit("# "), own_title, F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["t"]), "\n\n")).alias("text"),
        F.lit(False).alias("is_table"), none.alias("table_index"), none.alias("parent_page_index"),
    )

    def beside(t: Column) -> Column:
        n = t["table_no"]
        return F.struct(
            (n + 10000).alias("unit_index"), F.lit("table").alias("unit_type"), F.concat(F.coalesce(title, F.lit("본문")), F.lit(" — 표 "), n.cast("string")).alias("title"),
            t["t"].alias("text"), F.lit(True).alias("is_table"), n.alias("table_index"), (F.col("index") - filled + 1).alias("parent_page_index"),
        )

    # Both kinds of units come out of one pass over the sections.
    tables = F.transform("tables", beside)
    units = F.concat(F.when(filled == 1, F.array(own)).otherwise(F.array().cast(_SECTION_UNITS)), tables.cast(_SECTION_UNITS))
    out = sections.select("doc_id", path.alias("section_path"), F.explode(units).alias("u"))
    return out.select("doc_id", "u.unit_index", "u.unit_type", "u.title", "section_path", "u.text", "u.is_table", "u.table_index", "u.parent_page_index")


# ---------------------------------------------------------------- damage and recovery


def broken_glyphs(text: Column) -> Column:
    """Number of glyph placeholders and of code points that no clean text holds."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(CID)) + F.regexp_count(text, F.lit(ODD_GLYPH))


def flattened_table(text: Column) -> Column:
    """Signs of a table whose cell borders were lost."""
    text = F.coalesce(text, F.lit(""))
    return F.rlike(text, F.lit(DIGIT_RUN)) | F.rlike(text, F.lit(GLUED_BULLET)) | (F.regexp_count(text, F.lit(GLUED_CELL)) >= 3)


def needs_recovery(text: Column, has_images: Column, clean_chars: int = CLEAN_CHARS) -> Column:
    """Damage asks for recovery; a clean page does so only if it has images and little text."""
    body = tx.strip(F.coalesce(text, F.lit("")))
    return (
        F.when((broken_glyphs(body) > 0) | flattened_table(body), F.lit(True))
        .when(~has_images, F.lit(False))
        .otherwise(F.length(body) < clean_chars)
    )


def merge_recovered_text(pages: DataFrame, recovered: DataFrame, keys: list[str], min_chars: int = RECOVERED_CHARS) -> DataFrame:
    """Page text with its recovered text: in its place if only the page is broken, else behind it."""
    fresh = recovered.select(*keys, tx.strip(F.col("recovered")).alias("recovered")).filter(F.length("recovered") >= min_chars)
    out = pages.join(fresh, keys, "left")
    original = tx.strip(F.coalesce("text", F.lit("")))
    swap = (broken_glyphs(original) > 0) & (broken_glyphs(F.col("recovered")) == 0)
    merged = (
        F.when(F.col("recovered").isNull(), original)
        .when(swap, F.col("recovered"))
        .otherwise(tx.strip(F.concat_ws("\n\n", _nonempty(original), F.col("recovered"))))
    )
    how = F.when(F.col("recovered").isNull(), "kept").when(swap, "replaced").otherwise("appended")
    return out.withColumn("how", how).withColumn("text", merged).drop("recovered")
