"""Text expressions: tokens, whitespace, slugs, ids. All run inside the JVM."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\s\x1c-\x1f]"
SPACES = rf"(?U){SPACE_CLASS}+"

# The lexical and the evidence token patterns and the stop words
# of the latter.
LEXICAL_TOKEN = "[a-z0-9$]+"
EVIDENCE_TOKEN = "[a-z0-9]+"
STOP_WORDS = (
    "a", "an", "and", "are", "does", "for", "from", "how", "in",
    "is", "of", "on", "or", "the", "to", "what", "with",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def words(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0))


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACES, " "))


def slug(heading: Column) -> Column:
    joined = F.btrim(F.regexp_replace(heading, "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    short = F.substring(F.lower(joined), 1, 40)
    return F.coalesce(blank_to_null(short), F.lit("section"))


def padded(number: Column) -> Column:
    """At least two digits."""
    return F.format_string("%02d", number)


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL_TOKEN), F.lit(0))


def content_terms(text: Column) -> Column:
    """Distinct evidence terms: longer than two characters, no stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(EVIDENCE_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def share_of(left: Column, right: Column) -> Column:
    """Share of the distinct items of ``left`` that also occur in ``right``; 0 when empty."""
    return F.when(F.size(left) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(F.array_distinct(left))
    )


def token_overlap(left: Column, right: Column) -> Column:
    return share_of(lexical_tokens(left), lexical_tokens(right))


def unique_ignoring_case(items: Column) -> Column:
    """Distinct strings ignoring case; the first spelling and the order stay."""
    lowered = F.transform(items, F.lower)
    return F.filter(
        items, lambda x, i: F.array_position(lowered, F.lower(x)) == (i + 1).cast("long")
    )


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


# Fixed value: the URL namespace of RFC 9562.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based SHA-1 UUID (RFC 9562, version 5)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))

    def part(start: int, length: int) -> Column:
        return F.substring(digest, start, length)

    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat_ws(
        "-",
        part(1, 8),
        part(9, 4),
        F.concat(F.lit("5"), part(14, 3)),
        F.concat(variant, part(18, 3)),
        part(21, 12),
    )


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """Resolve HTML character references."""
    return text.map(html.unescape, na_action="ignore")
