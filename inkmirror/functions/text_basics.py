"""String semantics shared by all expressions.

Titles, ids and bodies follow ECMAScript string rules: Unicode white space in
``trim``, lengths in UTF-16 units, ``parseInt`` on a leading number, and empty
strings that count as missing. Java's ``\\s``, ``$`` and ``\\b`` differ, so the
patterns below spell out what they mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ECMAScript white-space and line-terminator code points.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# The same without the line feed, for rules that look at one line.
WS_IN_LINE = r"[\t\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# All of them as one string of characters.
WS_CHARS = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
# ASCII word boundary after a tag name.
TAG_END = r"(?![A-Za-z0-9_])"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_all(value: Column | str) -> Column:
    return F.trim(as_col(value), F.lit(WS_CHARS))


def trim_start(value: Column | str) -> Column:
    return F.ltrim(as_col(value), F.lit(WS_CHARS))


def present(value: Column | str) -> Column:
    """The string, or NULL where it is missing or empty."""
    return F.nullif(as_col(value), F.lit(""))


def has_text(value: Column | str) -> Column:
    """True for a non-empty string (a single blank counts as text)."""
    return F.coalesce(as_col(value), F.lit("")) != ""


def leading_int(value: Column | str) -> Column:
    """Leading integer of a string as BIGINT, NULL where there is none."""
    value = as_col(value)
    # a cast reads what begins with a digit alike, or not at all; one that fails is slow
    plain = F.when(F.left(value, F.lit(1)).between("0", "9"), value.try_cast("bigint"))
    found = F.regexp_extract(value, rf"^{WS}*([+-]?\d+)", 1).try_cast("bigint")
    return F.coalesce(plain, F.when(value.rlike(rf"^{WS}*[+-]?\d"), found))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it.

    Columns are trees, so naming a long expression twice doubles the plan; a lambda
    variable keeps both the plan and the work linear.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utf16_prefix(value: Column | str, units: int) -> Column:
    """First ``units`` UTF-16 units; a surrogate pair cut in half is dropped.

    Strings of at most half as many code points always fit and skip the encoding.
    """

    def cut_off(raw: Column) -> Column:
        last = F.hex(F.substring(raw, 2 * units - 1, 1))
        size = F.when(last.isin("D8", "D9", "DA", "DB"), 2 * units - 2).otherwise(2 * units)
        return F.decode(F.substring(raw, F.lit(1), size), "UTF-16BE")

    def shortened(text: Column) -> Column:
        # more code points than units: the rest is out of reach of the prefix
        near = F.substring(text, 1, units)
        return F.when(F.length(text) <= units // 2, text).otherwise(bind(F.encode(near, "UTF-16BE"), cut_off))

    return bind(as_col(value), shortened)


def replace_each_match(text: Column, pattern: str, replacement, may_fail: bool = False) -> Column:
    """Replace every match by ``replacement(matched_text)``, a Column of the match.

    Splits the text at the matches and joins the pieces again, so the value may
    come from data (a map, a computed code point) and needs no Python. With
    ``may_fail`` a NULL replacement makes the whole result NULL.
    """

    def pieces(source: Column) -> Column:
        matches = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
        # the n-th piece follows the n-th match; the first piece follows nothing
        heads = F.concat(F.array(F.lit("")), F.transform(matches, replacement))
        return F.zip_with(F.split(source, pattern, -1), heads, lambda piece, head: F.concat(head, piece))

    def checked(parts: Column) -> Column:
        return F.when(~F.exists(parts, lambda part: part.isNull()), F.array_join(parts, ""))

    parts = bind(text, pieces)
    return bind(parts, checked) if may_fail else F.array_join(parts, "")
