"""Packing, splitting and merging of units into chunks.

Where a chunk ends depends on the sizes summed since the last end, which no
window can say. Only these sizes, as integer arrays, go through small Arrow
functions; texts are cut and joined by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.folds import size_groups
from loomstone.plans.ordered import Edge, position_bucket, scan
from loomstone.session import written

# Merge and split limits per format, the older packer, table shape.
SIZE_THRESHOLDS = [
    ("pptx", 200, 800),
    ("pdf", 300, 1500),
    ("docx", 300, 1500),
    ("txt", 200, 1200),
    ("md", 200, 1200),
    ("xlsx", 0, 1500),
]
DEFAULT_FORMAT = "txt"
OLD_CHARS, OLD_OVERLAP = 1200, 200
WINDOW_OVERLAP = 50
PIPE_ROW = f"(?s)^{tx.WS}*\\|.*\\|{tx.WS}*$"
TABLE_SHARE, TABLE_LINES = 0.8, 3
HEADER_SLACK = 120

_PIECE = "array<struct<kind:int,first:int,last:int,a:int,b:int>>"
PACKED, WINDOW, ROWS = 0, 1, 2


def size_thresholds(format_col: Column) -> tuple[Column, Column]:
    """(merge_below, split_above) of a format; an unknown one takes the limits of plain text."""
    merge, split = F.lit(None).cast("int"), F.lit(None).cast("int")
    default = next((m, s) for name, m, s in SIZE_THRESHOLDS if name == DEFAULT_FORMAT)
    for name, m, s in SIZE_THRESHOLDS:
        merge = F.coalesce(merge, F.when(format_col == name, F.lit(m)))
        split = F.coalesce(split, F.when(format_col == name, F.lit(s)))
    return F.coalesce(merge, F.lit(default[0])), F.coalesce(split, F.lit(default[1]))


# ---------------------------------------------------------------- integer folds


def _pieces(sizes: Sequence[int], limit: int, overlap: int, step: int, tables: Sequence[Sequence[int]] | None) -> list[dict]:
    """Ends of packed paragraphs, windows over long ones, row ranges of long tables.

    A table is (head rows, head length, row lengths...) at its paragraph, an
    empty array elsewhere. A packed piece is the last ``a`` characters of the
    paragraphs first..last, which takes in the overlap with the piece before.
    """
    out: list[dict] = []
    start, spent, chars, begin = None, 0, 0, 0

    def close(last: int) -> None:
        nonlocal start
        if start is not None:
            out.append({"kind": PACKED, "first": begin, "last": last, "a": chars, "b": 0})
        start = None

    for i, n in enumerate(sizes):
        if n > limit:
            close(i - 1)
            spent = 0
            table = tables[i] if tables is not None else ()
            if len(table):
                out.extend(_row_ranges(i, n, table, limit))
            else:
                out.extend({"kind": WINDOW, "first": i, "last": i, "a": at, "b": limit} for at in range(0, n, step))
        elif start is not None and spent + n + 2 > limit:
            whole, first = chars, begin
            close(i - 1)
            tail = min(overlap, whole)
            start, spent, chars = i, (tail + n + 2 if tail else n), (tail + n + 2 if tail else n)
            begin = _reach(sizes, i - 1, tail, first) if tail else i
        else:
            if start is None:
                start, begin, spent, chars = i, i, n + 2, n
            else:
                spent, chars = spent + n + 2, chars + n + 2
    close(len(sizes) - 1)
    return out


def _reach(sizes: Sequence[int], last: int, tail: int, first: int) -> int:
    """First paragraph needed so that the join up to ``last`` has ``tail`` characters."""
    have, at = sizes[last], last
    while have < tail and at > first:
        at -= 1
        have += sizes[at] + 2
    return at


def _row_ranges(i: int, n: int, table: Sequence[int], limit: int) -> list[dict]:
    head, base, rows = table[0], table[1] + 1, table[2:]
    out, begin, spent = [], None, base
    for r in range(head, len(rows)):
        add = rows[r] + 1
        if begin is not None and spent + add > limit:
            out.append({"kind": ROWS, "first": i, "last": i, "a": begin, "b": r - begin})
            begin, spent = None, base
        begin = r if begin is None else begin
        spent += add
    if begin is not None:
        out.append({"kind": ROWS, "first": i, "last": i, "a": begin, "b": len(rows) - begin})
    return out or [{"kind": PACKED, "first": i, "last": i, "a": n, "b": 0}]


def _piece_udf(overlap: int, window_overlap: int):
    @F.pandas_udf(_PIECE)
    def pieces(sizes: pd.Series, limits: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series(
            [_pieces(s.tolist(), int(m), overlap, max(int(m) - window_overlap, 1), t) for s, m, t in zip(sizes, limits, tables)]
        )

    return pieces


# ---------------------------------------------------------------- text splitting


def _filled_lines(block: Column) -> Column:
    return F.filter(tx.lines(block), lambda x: ~tx.blank(x))


def is_markdown_table(block: Column) -> Column:
    """At least three filled lines, four fifths of them pipe rows."""

    def share(rows: Column) -> Column:
        piped = F.size(F.filter(rows, lambda x: F.rlike(x, F.lit(PIPE_ROW))))
        return (F.size(rows) >= TABLE_LINES) & (piped >= F.size(rows) * F.lit(TABLE_SHARE))

    return tx.let(_filled_lines(block), share)


def _head_rows(rows: Column) -> Column:
    """Lines repeated at the head of every part: two if the second is a pipe row, else up to three."""
    second = F.rlike(F.coalesce(F.get(rows, F.lit(1)), F.lit("")), F.lit(PIPE_ROW))
    return F.when(second, F.lit(2)).otherwise(F.least(F.lit(3), F.size(rows)))


def _split_frame(df: DataFrame, text_col: str, limit: Column, overlap: int, window_overlap: int, with_tables: bool) -> DataFrame:
    """Add ``parts``, the pieces of the text as an array; everything happens inside the row."""
    paras = df.withColumn("_limit", limit.cast("int")).withColumn("_paras", tx.paragraphs(F.col(text_col)))
    none = F.array().cast("array<int>")
    if with_tables:
        tall = (F.length("_p") > F.col("_limit")) & is_markdown_table(F.col("_p"))
        # Lines of long tables only; other paragraphs get an empty array.
        empty = F.array().cast("array<string>")
        paras = paras.withColumn(
            "_rows",
            F.transform("_paras", lambda p: F.when((F.length(p) > F.col("_limit")) & is_markdown_table(p), _filled_lines(p)).otherwise(empty)),
        )

        def measure(rows: Column) -> Column:
            head = _head_rows(rows)
            head_chars = F.length(F.array_join(F.slice(rows, 1, head), "\n"))
            return F.when(F.size(rows) > 0, F.concat(F.array(head, head_chars), F.transform(rows, F.length))).otherwise(none)

        tables = F.transform("_rows", measure)
    else:
        paras = paras.withColumn("_rows", F.array().cast("array<array<string>>"))
        tables = F.transform("_paras", lambda _: none)
    paras = paras.withColumn("_sizes", F.transform("_paras", F.length)).withColumn("_tables", tables)
    cut = paras.withColumn("_pieces", _piece_udf(overlap, window_overlap)("_sizes", "_limit", "_tables"))

    def piece(p: Column) -> Column:
        packed = F.right(F.array_join(F.slice("_paras", p["first"] + 1, p["last"] - p["first"] + 1), "\n\n"), p["a"])
        window = F.substring(F.get("_paras", p["first"]), p["a"] + 1, p["b"])
        rows = F.get("_rows", p["first"])
        table = F.array_join(F.concat(F.slice(rows, 1, _head_rows(rows)), F.slice(rows, p["a"] + 1, p["b"])), "\n")
        return F.when(p["kind"] == PACKED, packed).when(p["kind"] == WINDOW, window).otherwise(table)

    parts = F.transform("_pieces", piece)
    whole = F.array(F.left(F.col(text_col), F.col("_limit")))
    cut = cut.withColumn("parts", F.when(F.size("_pieces") > 0, parts).otherwise(whole))
    return cut.drop("_limit", "_paras", "_rows", "_sizes", "_tables", "_pieces")


def split_text(df: DataFrame, text_col: str, limit: Column, window_overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Add ``parts``: paragraphs packed up to the limit, long tables cut between rows, long prose in windows."""
    return _split_frame(df, text_col, limit, 0, window_overlap, with_tables=True)


def paragraph_chunks(df: DataFrame, text_col: str, max_chars: int = OLD_CHARS, overlap: int = OLD_OVERLAP) -> DataFrame:
    """Add ``parts``: the older packer, where a chunk starts with the end of the one before."""
    filled = df.filter(F.length(text_col) > 0)
    return _split_frame(filled, text_col, F.lit(max_chars), overlap, overlap, with_tables=False)


def sliding_windows(df: DataFrame, text_col: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; the last ones may lie inside the one before."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step))
    rows = df.filter(F.length(text_col) > 0).select("*", F.posexplode(starts).alias("window_no", "_at"))
    return rows.withColumn("window", F.substring(F.col(text_col), F.col("_at") + 1, F.lit(size))).drop("_at")


def split_table_rows(df: DataFrame, text_col: str, limit: Column) -> DataFrame:
    """Add ``parts``: a table cut between rows, its head lines repeated in each part."""
    rows = df.withColumn("_limit", limit.cast("int")).withColumn("_rows", _filled_lines(F.col(text_col)))
    head = _head_rows(F.col("_rows"))
    shape = F.concat(F.array(head, F.length(F.array_join(F.slice("_rows", 1, head), "\n"))), F.transform("_rows", F.length))

    @F.pandas_udf(_PIECE)
    def ranges(shapes: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([_row_ranges(0, 0, s.tolist(), int(m)) for s, m in zip(shapes, limits)])

    rows = rows.withColumn("_head", head).withColumn("_shape", shape).withColumn("_pieces", ranges("_shape", "_limit"))

    def part(p: Column) -> Column:
        body = F.concat(F.slice("_rows", 1, F.col("_head")), F.slice("_rows", p["a"] + 1, p["b"]))
        return F.when(p["kind"] == ROWS, F.array_join(body, "\n")).otherwise(F.col(text_col))

    return rows.withColumn("parts", F.transform("_pieces", part)).drop("_limit", "_rows", "_head", "_shape", "_pieces")


# ---------------------------------------------------------------- headers of split parts


def context_header(section_path: Column, title: Column) -> Column:
    """Section path and title, each once, blank ones left out."""
    named = F.filter(F.array(tx.strip(F.coalesce(section_path, F.lit(""))), tx.strip(F.coalesce(title, F.lit("")))), lambda x: x != "")
    return F.array_join(F.array_distinct(named), " / ")


def with_header(fragment: Column, header: Column) -> Column:
    """Fragment with its header in front, unless the header already stands near its start."""
    near = F.contains(F.left(fragment, F.length(header) + HEADER_SLACK), header)
    first_line = tx.strip(F.split(F.ltrim(fragment, F.lit(tx.WHITESPACE)), "\n")[0])
    return F.when((header == "") | near | (first_line == header), fragment).otherwise(F.concat(header, F.lit("\n\n"), fragment))


# ---------------------------------------------------------------- units to chunks


def _chunk_of(sizes: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk): which units make one chunk, named by its first position, from sizes alone.

    A run is consecutive short units of one section and the unit that may take
    in what is left of them; nothing carries over from run to run.
    """

    def starts_run(now: Callable[[str], Column], before: Callable[[str], Column]) -> Column:
        same_path = before("section_path").eqNullSafe(now("section_path"))
        follows = (before("role") == "short") & ((now("role") == "fit") | ((now("role") == "short") & same_path))
        return ~F.coalesce(follows, F.lit(False))

    sizes = scan(sizes, ["doc_id"], ["pos"], position_bucket("pos"), edges={"run": Edge(["role", "section_path"], starts_run)})
    short = size_groups(sizes.where("role = 'short'"), ["doc_id", "run"], "pos", "n", "merge_below")
    whole = sizes.where("role <> 'short'").select("doc_id", "run", "pos", "role", "n", "split_above", "merge_below")
    # What is left of a run is the one group that stayed below the limit. Its texts are joined by two characters.
    groups = short.groupBy("doc_id", "run", "first").agg(F.sum("n").alias("size"), F.count_if(F.col("n") > 0).alias("filled"))
    next_to = whole.where("role = 'fit'").join(groups, ["doc_id", "run"])
    taken = next_to.where((F.col("size") < F.col("merge_below")) & (F.col("size") + 2 * F.col("filled") + F.col("n") <= F.col("split_above")))
    taken = taken.select("doc_id", "pos", F.col("first").alias("taken"))
    wholes = whole.select("doc_id", "pos").join(taken, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("taken", F.col("pos").cast("long")).alias("chunk"))
    return short.select("doc_id", F.col("pos"), F.col("first").alias("chunk")).unionByName(wholes)


def adaptive_chunk(units: DataFrame) -> DataFrame:
    """Chunks of the units of (doc_id, pos, doc_format, unit_index, unit_type, title, section_path, text,
    is_table, table_index, parent_page_index).

    Long units are split, short ones merged with their neighbours of the same
    section until they are long enough, and what is left of a row of short
    units is taken in by the next unit if both fit. Which units make a chunk is
    found from their sizes alone (``_chunk_of``); texts then meet by chunk, so a
    document may have any number of units. The sizes are written to the shared
    folder, as several steps meet them, so texts are read twice: keep the units
    in a table if they are costly to make.
    """
    merge_below, split_above = size_thresholds(F.col("doc_format"))
    size = F.length("text")
    units = units.withColumn("merge_below", merge_below).withColumn("split_above", split_above)
    role = (
        F.when(F.col("is_table") & (size > F.col("split_above")), "split")
        .when(F.col("is_table"), "table")
        .when(size > F.col("split_above"), "split")
        .when((size < F.col("merge_below")), "short")
        .otherwise("fit")
    )
    units = units.withColumn("role", role)
    sizes = units.select("doc_id", "pos", "role", "section_path", size.cast("long").alias("n"), "merge_below", "split_above")
    chunks = _chunk_of(written(sizes, "unit-sizes"))
    kept = ["pos", "unit_index", "unit_type", "title", "section_path", "text", "is_table", "table_index", "parent_page_index", "role"]
    met = units.join(chunks, ["doc_id", "pos"]).groupBy("doc_id", "chunk").agg(
        F.first("doc_format").alias("doc_format"), F.first("split_above").alias("split_above"), F.array_sort(F.collect_list(F.struct(*kept))).alias("u")
    )
    short = F.filter("u", lambda x: x["role"] == "short")
    met = met.withColumn("short", short).withColumn("whole", F.get(F.filter("u", lambda x: x["role"] != "short"), F.lit(0)))

    def joined(members: Column) -> Column:
        return F.array_join(F.filter(F.transform(members, lambda x: x["text"]), lambda t: t != ""), "\n\n")

    def titles(members: Column) -> Column:
        return F.filter(F.transform(members, lambda x: x["title"]), lambda t: t != "")

    whole, first = F.col("whole"), F.col("u")[0]
    ids, no_ids = F.transform("short", lambda x: x["unit_index"].cast("int")), F.array().cast("array<int>")
    like = F.coalesce(whole, first)
    many, alone, takes = F.size("short") > 1, whole.isNull(), whole.isNotNull() & (F.size("short") > 0)
    before = joined(F.col("short"))
    title = F.when(alone & many, F.array_join(titles(F.col("short")), " + ")).when(takes & (whole["title"] == ""), F.coalesce(F.get(titles(F.col("short")), F.lit(0)), F.lit("")))
    text = F.when(alone & many, before).when(takes & (before != ""), F.concat(before, F.lit("\n\n"), whole["text"]))
    flat = met.select(
        "doc_id", "doc_format", "split_above", like["pos"].alias("pos"), first["unit_index"].cast("int").alias("unit_index"), like["unit_type"].alias("unit_type"),
        F.coalesce(title, like["title"]).alias("title"), like["section_path"].alias("section_path"), F.coalesce(text, like["text"]).alias("text"),
        like["is_table"].alias("is_table"), like["table_index"].alias("table_index"), like["parent_page_index"].alias("parent_page_index"),
        F.when(alone & many, ids).otherwise(no_ids).alias("merged_units"), F.when(takes, ids).otherwise(no_ids).alias("absorbed_units"),
        (like["role"] == "split").alias("_split"),
    )

    flat = split_text(flat.withColumn("_long", F.when(F.col("_split"), F.col("text")).otherwise("")), "_long", F.col("split_above"))
    pieces = F.when(F.col("_split"), F.col("parts")).otherwise(F.array("text"))
    flat = flat.withColumn("n_parts", F.size(pieces)).select("*", F.posexplode_outer(pieces).alias("_i", "_part"))
    header = context_header(F.col("section_path"), F.col("title"))
    several = F.col("_split") & (F.col("n_parts") > 1)
    marked = F.concat("title", F.lit(" (part "), (F.col("_i") + 1).cast("string"), F.lit("/"), F.col("n_parts").cast("string"), F.lit(")"))
    text = F.when(F.col("_split") & ~F.col("is_table"), with_header(F.col("_part"), header)).otherwise(F.col("_part"))
    split_part = F.when(F.col("_split"), F.concat((F.col("_i") + 1).cast("string"), F.lit("/"), F.col("n_parts").cast("string")))
    return flat.select(
        "doc_id", "doc_format", "pos", (F.col("_i") + 1).alias("part_no"), "unit_index", "unit_type",
        F.when(several, marked).otherwise(F.col("title")).alias("title"), "section_path", text.alias("text"), "is_table",
        "table_index", "parent_page_index", "merged_units", "absorbed_units", split_part.alias("split_part"),
    )
