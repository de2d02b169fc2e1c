"""Whitespace, line and token helpers, all native Catalyst expressions.

White space means Unicode white space plus the separators U+001C..U+001F.
Spark's ``trim`` removes plain spaces unless it is given a set, and Java's
``\\s`` is ASCII unless ``(?U)`` is set. The patterns are possessive and
anchored so that long runs stay linear.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s\x1c-\x1f"
# The white space characters that stripping removes.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_TOKEN = rf"(?U)[^{WS}]++"
# From the first digit to the end of its token: one match per token with a digit.
_DIGIT_TOKEN = rf"(?U)\d[^{WS}]*+"


def computed_once(col: Column) -> Column:
    """Fence around a costly column.

    Catalyst copies a column's expression into every filter it pushes below the
    projection, and filters share no subexpressions. A term that Spark treats as
    non-deterministic (and that is always true) keeps the filter above, so the
    column is computed once per row.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def text_or_empty(col: Column) -> Column:
    """A missing string counts as the empty string."""
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Looks at the edges only, unlike a regular expression."""
    return F.btrim(col, F.lit(WS_CHARS))


def strip_left(col: Column) -> Column:
    return F.ltrim(col, F.lit(WS_CHARS))


def is_blank(col: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(col.rlike(rf"(?U)[^{WS}]"), F.lit(False))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(_TOKEN), F.lit(0))


def token_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(_TOKEN))


def digit_token_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(_DIGIT_TOKEN))


def lines(col: Column) -> Column:
    """Split at line feeds only."""
    return F.split(col, "\n", -1)


def occurrences(col: Column, needle: str) -> Column:
    """Non-overlapping substring count.

    Works on byte lengths, which Spark keeps with each string. ``contains``
    scans faster than ``replace``, and most needles are absent.
    """
    removed = F.octet_length(col) - F.octet_length(F.replace(col, F.lit(needle), F.lit("")))
    count = (removed / F.lit(len(needle.encode("utf-8")))).cast("int")
    return F.when(F.contains(col, F.lit(needle)), count).otherwise(0)


def truncate(col: Column, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(col, 1, n)
