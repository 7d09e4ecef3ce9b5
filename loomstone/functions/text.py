"""String column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space and as line ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = f"[{WHITESPACE}]"
NOT_WS = f"[^{WHITESPACE}]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Fixed value: the token pattern of the lexical index.
TOKEN = "[가-힣a-zA-Z0-9]+"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def blank(col: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(F.length(strip(col)) == 0, F.lit(True))


def squeeze(col: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(col, f"{WS}+", "")


def lines(col: Column) -> Column:
    return F.split(col, LINE_BREAK)


def nonblank_lines(col: Column) -> Column:
    """Stripped lines, blank ones left out."""
    return F.filter(F.transform(lines(col), strip), lambda x: x != "")


def paragraphs(col: Column) -> Column:
    """Stripped blocks between blank lines, empty ones left out."""
    return F.filter(F.transform(F.split(col, f"\n{WS}*\n"), strip), lambda x: x != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(f"({TOKEN})"), 1)


def term_counts(words: Column) -> Column:
    """Array of (term, tf) from an array of words, linear after one in-row sort.

    Equal words sit next to each other after sorting, so a count is the
    distance between two starts; nothing leaves the row.
    """

    def runs(sorted_words: Column) -> Column:
        n = F.size(sorted_words)
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == 1) | (F.element_at(sorted_words, i) != F.element_at(sorted_words, F.greatest(i - 1, F.lit(1)))),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, at: F.struct(
                    F.element_at(sorted_words, start).alias("term"),
                    (F.coalesce(F.get(s, at + 1), n + 1) - start).alias("tf"),
                ),
            ),
        )

    empty = F.expr("cast(array() as array<struct<term:string,tf:int>>)")
    return F.when(F.size(words) == 0, empty).otherwise(let(F.sort_array(words), runs))


def contains_any(col: Column, phrases: Sequence[str]) -> Column:
    """True if any phrase occurs, case left out of account."""
    low = F.lower(F.coalesce(col, F.lit("")))
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(low, F.lit(phrase.lower()))
    return found


def replace_all(col: Column, phrases: Sequence[str], by: str) -> Column:
    for phrase in phrases:
        col = F.replace(col, F.lit(phrase), F.lit(by))
    return col


def unfence(col: Column) -> Column:
    """Inside of a ``` block, with a leading json tag and trailing ticks cut; other text as it is."""
    inner = F.split(col, "```")[1]
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 2**31 - 1)).otherwise(inner)
    inner = strip(F.rtrim(strip(inner), F.lit("`")))
    return F.when(F.startswith(col, F.lit("```")), inner).otherwise(col)


def two_digits(col: Column) -> Column:
    """A small number with two digits, rounded by its exact binary value as printf does."""
    return F.format_number(col, 2)


def _digit_table() -> tuple[str, str]:
    """All decimal digits beyond 0-9, and for each the ASCII digit of its value."""
    import sys
    import unicodedata

    others = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd" and c < 0x10000]
    return "".join(others), "".join(str(unicodedata.digit(c)) for c in others)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9; other characters stay."""
    return F.translate(text, *_digit_table())
