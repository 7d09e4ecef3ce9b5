"""Chat formatting with a round trip: render, parse the text again, escape where the parse differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
# A control string begins with "<|". Escaping puts one backslash more between the two characters, so no text can hold
# the beginning of a control string and taking one backslash away gives the text back.
OPENING, OPENED = r"<(\\*)\|", r"<$1\\|"
ESCAPED, UNESCAPED = r"<(\\*)\\\|", r"<$1|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, OPENING, OPENED)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, UNESCAPED)


def escape_role(role: Column) -> Column:
    """A role stands alone on its line: percent, line feed and less-than are written as percent codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _rendered(turns: Column) -> Column:
    """Text of turns (role, text) whose fields are escaped already."""
    one = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) as they stand in a formatted text; the grammar is deterministic.

        conversation := turn*        turn := START role LF text END LF

    A piece between two STARTs that does not end in END LF, or anything before
    the first START, makes the parse null.
    """
    pieces = F.split(formatted, r"<\|im_start\|>")
    tail = END + "\n"
    turn = lambda p: F.struct(
        F.substring_index(p, "\n", 1).alias("role"),
        F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(tail)).alias("text"),
    )
    bodies = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    sound = (F.element_at(pieces, 1) == "") & F.forall(bodies, lambda p: p.endswith(tail) & (F.locate("\n", p) <= F.length(p) - len(tail)) & (F.length(F.replace(p, F.lit(END))) == F.length(p) - len(END)))
    return F.when(sound, F.transform(bodies, turn))


def format_conversations(rows: DataFrame, masked_role: str = "assistant") -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) rows.

    Columns: conv_id, formatted, escaped (whether any text had to be), mask
    (array of start, length in code points of the spans under the loss: the
    texts of ``masked_role``), turns (role, text; read back from formatted).

    Turns stand by turn, then role, then text, nulls first; repeated rows are
    repeated turns. Null roles and texts are empty; rows of a null conv_id are
    one conversation. A formatted conversation is one value, so all its turns
    meet in one row: its size is the size of the output, not of a group's count.

    The first rendering escapes nothing. Where its parse differs from the
    source, the texts are escaped and rendered again; a second difference
    stops the job, as it would mean a broken grammar.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    roles = lambda t: escape_role(t["role"]).alias("role")
    plain = F.transform("source", lambda t: F.struct(roles(t), t["text"].alias("text")))
    safe = F.transform("source", lambda t: F.struct(roles(t), escape(t["text"]).alias("text")))
    back = lambda turns: F.transform(turns, lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))

    first = convs.withColumn("_body", plain).withColumn("formatted", _rendered(F.col("_body")))
    first = first.withColumn("escaped", ~back(parse(F.col("formatted"))).eqNullSafe(F.col("source")))
    second = first.withColumn("_body", F.when(F.col("escaped"), safe).otherwise(F.col("_body")))
    second = second.withColumn("formatted", F.when(F.col("escaped"), _rendered(F.col("_body"))).otherwise(F.col("formatted")))
    second = second.withColumn("_raw", parse(F.col("formatted")))
    second = second.withColumn("turns", back(F.col("_raw")))
    same = F.col("turns").eqNullSafe(F.col("source"))
    second = second.withColumn("turns", F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("conversation does not parse back")).cast(second.schema["turns"].dataType)))

    # Where each turn's text lies in the formatted text: lengths of what stands before it.
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["role"]) + F.length(t["text"]) + len(START) + 1 + len(END) + 1).cast("long").alias("at"),
        F.when(
            unescape_role(t["role"]) == masked_role,
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["role"]) + len(START) + 1).cast("long").alias("start"), F.length(t["text"]).cast("long").alias("length")))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return second.select("conv_id", "formatted", "escaped", F.aggregate("_raw", zero, step, lambda acc: acc["spans"]).alias("mask"), "turns")


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def turns_digest(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)
