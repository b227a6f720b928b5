"""String helpers whose results must equal plain Python string handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip()/str.split() treat as blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = f"[{WHITESPACE}]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    It is the start value of an aggregate over nothing.  An array of one element would do as well, but reading
    its element derives the type of ``body``, with all that is nested in it, again for every row.
    """
    return F.aggregate(F.array(), value, lambda start, _: start, body)


def strip(c: Column) -> Column:
    """Trim every blank character, not only U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Runs of blanks become one space, ends are trimmed."""
    return F.regexp_replace(strip(c), _SPACE_RUN, " ")


def is_blank(c: Column) -> Column:
    """Null or the empty string, exactly; blanks count as content."""
    return c.isNull() | (c == F.lit(""))


def usable(c: Column, min_chars: int = 15) -> Column:
    """Enough characters left after trimming."""
    return F.coalesce(F.length(strip(c)) >= F.lit(min_chars), F.lit(False))


def truncate(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters and mark the cut."""
    text = F.coalesce(c, F.lit(""))
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


def digest(c: Column) -> Column:
    """Short hash and length; absent content gives (null, 0)."""
    blank = is_blank(c)
    return F.struct(
        F.when(~blank, F.substring(F.sha2(c, 256), 1, 12)).alias("sha256"),
        F.when(~blank, F.length(c)).otherwise(F.lit(0)).alias("chars"),
    )


def content_policy(c: Column, log_content: bool = False, max_chars: int = 500, as_given: bool = False) -> Column:
    """What may be stored of a content column.

    ``as_given``: only null is absent and stays null; the empty string is hashed like any other text.
    """
    stored = truncate(c, max_chars) if log_content else digest(c)
    if not as_given:
        return stored
    if log_content:
        return F.when(c.isNotNull(), stored)
    return F.struct(F.substring(F.sha2(c, 256), 1, 12).alias("sha256"), F.length(c).alias("chars"))


def premise(template: str, label: Column, value: Column) -> Column:
    """Fill ``{label}`` and ``{value}`` of a sentence template."""
    parts: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find(k), k) for k in ("{label}", "{value}") if k in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, key = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(label if key == "{label}" else value)
        rest = rest[at + len(key):]
    return F.concat(*parts)


def unit_draw(c: Column, digits: int = 8, offset: int = 0) -> Column:
    """A number in [0, 1] from ``digits`` hex characters of a digest column."""
    hexed = F.substring(c, 1 + offset, digits)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(16**digits - 1))


def normalise_value(c: Column, data_type: str) -> Column:
    """One text form per value: ISO dates, trimmed text, whole numbers bare."""
    if data_type in ("date", "timestamp", "timestamp_ntz"):
        return F.date_format(c, "yyyy-MM-dd")
    if data_type in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e18))
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if data_type == "string":
        return strip(c)
    return c.cast("string")


def normalise_frame(df):
    """B7 over every column of a frame; nested columns are left as they are."""
    simple = {"date", "timestamp", "timestamp_ntz", "double", "float", "string", "int", "bigint", "smallint"}
    return df.select(
        *[
            normalise_value(F.col(name), kind).alias(name) if kind in simple else F.col(name)
            for name, kind in df.dtypes
        ]
    )
