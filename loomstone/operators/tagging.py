"""Entities, chunk ids and per-document attributes of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loomstone.functions import text as tx
from loomstone.plans.ordered import position_bucket, scan

# Entity patterns (case counts only where noted), counter words, default dictionary and limits.
COUNTERS = "명|억|만원|만\\s*원|억\\s*원|시간|분|일|차|곳|개|단계|자|회|건|개월|년|％|%|원|건수|명\\+|건\\+"
ENTITY_PATTERNS = {
    "time": r"(?U)\b(\d{1,2}:\d{2})\b",
    "abbr": r"(?U)\b([A-Z]{2,}[A-Z0-9]*)\b",
    "structural": r"(?Uiu)\b(Day\s*[1-9]|Phase\s*[1-9]|[1-9]\s*단계|[A-C]안|Step\s*[1-9])\b",
    "number_unit": rf"(?U)\b(\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?)\s*({COUNTERS})\b",
    "quoted": r"""['‘"「『]([^'’"」』]{2,30})['’"」』]""",
}
KEYWORDS = [
    "Make", "Make.com", "Vrew", "Canva",
    "FP", "OM", "CM", "Career Manager", "Operations Manager", "Franchise Partner",
    "Alignment", "Alliance", "Onboarding", "Engagement", "Optimization",
    "SSO", "Single Sign-On",
]
ENTITY_CHARS, ENTITY_COUNT = 50, 30
SUMMARY_CHARS, KEY_TERMS, SNIPPET_CHARS, TOPIC_CHARS = 300, 10, 5000, 40


def extract_entities(text: Column, keywords: Sequence[str] = KEYWORDS, chars: int | None = ENTITY_CHARS, most: int | None = ENTITY_COUNT) -> Column:
    """Dictionary words and pattern matches of a text: lower case, distinct, in order.

    Matches longer than ``chars`` are left out and the first ``most`` are kept;
    None lifts a limit. The default words name no people; pass your own.
    """
    text = F.coalesce(text, F.lit(""))
    named = tx.let(
        F.lower(text),
        lambda low: F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k)),
    )
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in ENTITY_PATTERNS.values()]
    clean = F.transform(F.concat(*found), lambda v: tx.strip(F.lower(tx.strip(v))))
    clean = F.filter(clean, lambda v: (v != "") & (F.lit(True) if chars is None else F.length(v) <= chars))
    every = F.array_sort(F.array_distinct(F.concat(named, clean)))
    return every if most is None else F.slice(every, 1, most)


def chunk_id(doc_id: Column, unit_index: Column, is_table: Column, table_index: Column, parent: Column, split_part: Column) -> Column:
    """``file::doc::page_n[::table_k][::part_iofn]``."""
    page = F.when(is_table & (F.coalesce(parent, F.lit(0)) != 0), parent).otherwise(unit_index)
    part = F.when(F.coalesce(split_part, F.lit("")) != "", F.concat(F.lit("part_"), F.replace(split_part, F.lit("/"), F.lit("of"))))
    return F.concat_ws(
        "::",
        F.lit("file"),
        doc_id.cast("string"),
        F.concat(F.lit("page_"), page.cast("string")),
        F.when(is_table, F.concat(F.lit("table_"), F.coalesce(table_index.cast("string"), F.lit("None")))),
        part,
    )


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    made = chunk_id(*[F.col(c) for c in ("doc_id", "unit_index", "is_table", "table_index", "parent_page_index", "split_part")])
    return chunks.withColumn("chunk_id", made)


def repeated_ids(chunks: DataFrame) -> DataFrame:
    """Chunk ids that more than one chunk claims."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1")


def tag_chunks(chunks: DataFrame, doc_attributes: DataFrame | None = None) -> DataFrame:
    """Chunks with id, length, entities and, where given, the (doc_id, doc_topic, doc_summary, key_terms) of their document.

    A ``doc_format`` the chunks bring along stays; it is null where they have none.
    """
    out = with_chunk_ids(chunks)
    out = out.withColumn("char_count", F.length("text")).withColumn("entities", extract_entities(F.col("text")))
    out = out.withColumn("display_title", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("doc_id").cast("string")))
    out = out.withColumn("source", F.lit("file")).withColumn("display_source", F.col("doc_id").cast("string"))
    if "doc_format" not in out.columns:
        out = out.withColumn("doc_format", F.lit(None).cast("string"))
    if doc_attributes is not None:
        out = out.join(doc_attributes, "doc_id", "left")
    else:
        out = out.withColumn("doc_topic", F.lit("general")).withColumn("doc_summary", F.lit("")).withColumn("key_terms", F.array().cast("array<string>"))
    return out.fillna({"doc_topic": "general", "doc_summary": ""})


def chunk_metadata(tagged: DataFrame, key_terms: str = "key_terms") -> DataFrame:
    """Tagged chunks with ``metadata``, the map that is stored beside a chunk.

    Keys and their order are fixed; values are texts, lists joined by blanks
    (entities) or ``, `` (terms and merged units). What is null or an empty list
    has no key; columns the chunks lack count as null.
    """
    has = set(tagged.columns)

    def given(name: str) -> Column:
        return F.col(name).cast("string") if name in has else F.lit(None).cast("string")

    def listed(name: str, by: str) -> Column:
        if name not in has:
            return F.lit(None).cast("string")
        if not isinstance(tagged.schema[name].dataType, ArrayType):
            return F.col(name).cast("string")
        texts = F.col(name).cast("array<string>")
        return F.when(F.size(texts) > 0, F.array_join(texts, by))

    values = {
        "doc_id": given("doc_id"), "doc_format": given("doc_format"), "page_unit_index": given("unit_index"), "page_unit_type": given("unit_type"),
        "page_unit_title": given("title"), "section_path": given("section_path"), "is_table": given("is_table"), "char_count": given("char_count"),
        "table_index": F.when(F.col("is_table"), given("table_index")), "parent_page_index": given("parent_page_index"),
        "merged_units": listed("merged_units", ", "), "split_part": given("split_part"), "entities": F.coalesce(listed("entities", " "), F.lit("")),
        "doc_topic": given("doc_topic"), "doc_summary": given("doc_summary"), "key_terms": F.coalesce(listed(key_terms, ", "), F.lit("")),
        "title": given("display_title"), "display_source": given("display_source"), "source": given("source"),
    }
    pairs = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])
    return tagged.withColumn("metadata", F.map_filter(pairs, lambda _, v: v.isNotNull()))


def drop_empty_metadata(attributes: Column) -> Column:
    """Attribute map without null values and empty lists (given as ``[]``)."""
    return F.map_filter(attributes, lambda _, v: v.isNotNull() & (v != "[]"))


def doc_snippet(units: DataFrame, chars: int = SNIPPET_CHARS) -> DataFrame:
    """First ``chars`` of the joined texts of each document of (doc_id, pos, text).

    Only units that start inside the kept length are gathered, so a document of
    any size costs at most that many characters.
    """
    filled = units.filter(F.length("text") > 0).select("doc_id", "pos", "text")
    ends = scan(filled, ["doc_id"], ["pos"], position_bucket("pos"), sums={"upto": (F.length("text") + 2).cast("long")}, levels=2)
    inside = ends.filter(F.col("upto") - F.length("text") - 2 < chars)
    inside = inside.select("doc_id", "pos", F.left("text", F.lit(chars)).alias("text"))
    packed = inside.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return packed.select("doc_id", F.left(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), F.lit(chars)).alias("snippet"))


def normalize_topic(raw: Column, chars: int | None = TOPIC_CHARS) -> Column:
    """Topic name from a verdict: first line, lower case, odd characters as ``_``; ``general`` if unusable."""
    first = tx.strip(F.split(tx.strip(raw), "\n")[0])
    name = F.btrim(F.regexp_replace(F.lower(first), r"[^\p{L}\p{N}_-]", "_"), F.lit("_-"))
    usable = (name != "") & (F.lit(True) if chars is None else F.length(name) <= chars)
    return F.when(F.coalesce(usable, F.lit(False)), name).otherwise(F.lit("general"))


def parse_doc_summary(raw: Column, chars: int | None = SUMMARY_CHARS, most: int | None = KEY_TERMS) -> Column:
    """(summary, key_terms) of a JSON verdict, fenced or not; empty where it cannot be read."""
    bare = F.regexp_replace(tx.strip(raw), f"^```(?:json)?{tx.WS}*", "")
    bare = F.regexp_replace(bare, f"{tx.WS}*```$", "")
    parsed = F.from_json(bare, "summary string, key_terms array<string>")
    terms = F.filter(F.transform(parsed["key_terms"], tx.strip), lambda t: t.isNotNull())
    terms = F.filter(terms, lambda t: t != "")
    terms = terms if most is None else F.slice(terms, 1, most)
    summary = tx.strip(parsed["summary"])
    return F.struct(
        F.coalesce(summary if chars is None else F.left(summary, F.lit(chars)), F.lit("")).alias("summary"),
        F.coalesce(terms, F.array().cast("array<string>")).alias("key_terms"),
    )


def doc_catalog(chunks: DataFrame) -> DataFrame:
    """One catalogue entry per document from its first chunk of (doc_id, pos, doc_summary, key_terms string)."""
    first = chunks.groupBy("doc_id").agg(F.min_by(F.struct("doc_summary", "key_terms"), F.col("pos")).alias("f"))
    first = first.select("doc_id", tx.strip(F.coalesce("f.doc_summary", F.lit(""))).alias("s"), tx.strip(F.coalesce("f.key_terms", F.lit(""))).alias("k"))
    entry = F.concat(F.lit("- ["), F.col("doc_id").cast("string"), F.lit("]\n  요약: "), "s", F.lit("\n  관련 어휘: "), "k")
    return first.filter(F.col("s") != "").select("doc_id", entry.alias("entry"))


def corpus_stats(chunks: DataFrame, by: list[str], short: int = 100) -> DataFrame:
    """Number and size distribution of chunks per group; a null group is a group, a null text a chunk without a length.

    Rows are counted per length first, and all figures come from those counts.
    Quantiles interpolate between the two lengths around their place, which
    running counts find, so no task gathers the lengths of a group.
    """
    n = F.length("text")
    counts = chunks.groupBy(*[F.col(c) for c in by], n.alias("n")).agg(F.count("*").alias("c"))
    known = F.when(F.col("n").isNotNull(), F.col("c"))
    is_short = F.when(F.col("n") < short, F.col("c"))
    totals = counts.groupBy(*by).agg(
        F.sum("c").alias("chunks"),
        F.sum(F.col("n").cast("long") * F.col("c")).alias("chars"),
        F.coalesce(F.sum(is_short), F.lit(0)).alias("short_chunks"),
        F.round(F.coalesce(F.sum(is_short), F.lit(0)) / F.sum(known), 6).alias("short_share"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.coalesce(F.sum(known), F.lit(0)).alias("_known"),
    )
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    lengths = counts.where("n IS NOT NULL").select(group.alias("_group"), "n", "c")
    running = scan(lengths, ["_group"], ["n"], position_bucket("n"), sums={"upto": F.col("c")}, levels=1).select("_group", "n", "upto")
    size = totals.select(group.alias("_group"), "_known")
    picked = []
    for name, q in (("median", 0.5), ("p95", 0.95)):
        at = F.lit(q) * (F.col("_known") - 1)
        low, high = (F.min(F.when(F.col("upto") > edge, F.col("n"))) for edge in (F.floor(at), F.ceil(at)))
        rest = F.max(at - F.floor(at))
        picked.append((low + (high - low) * rest).alias(name))
    quantiles = running.join(size, "_group").groupBy("_group").agg(*picked)
    out = totals.withColumn("_group", group).join(quantiles, "_group", "left")
    return out.drop("_group", "_known")
