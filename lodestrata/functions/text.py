"""Text column functions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shape of an artifact citation in prose, `Kind/name`; the name starts and ends alphanumeric.
CITATION = r"(?U)\b([A-Z][A-Za-z0-9]+)/([A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?)"

#: White space in the sense of Unicode, which SQL's trim (blanks only) leaves standing.
_EDGES = r"^[\s  -    　]+|[\s  -    　]+$"


def strip(text: Column) -> Column:
    """`text` without white space at its ends; null stays null."""
    return F.regexp_replace(text, _EDGES, "")


def slug(text: Column) -> Column:
    """Lower-case name with hyphens: a hyphen before every capital, other characters folded to one hyphen.

    Empty or symbol-only text gives `x`; null stays null.
    """
    spaced = F.regexp_replace(text, "([A-Z])", "-$1")
    folded = F.lower(F.trim(F.regexp_replace(spaced, "[^A-Za-z0-9]+", "-"), F.lit("-")))
    return F.when(text.isNotNull(), F.coalesce(F.nullif(folded, F.lit("")), F.lit("x")))


def citations(text: Column) -> Column:
    """Array of structs (kind, name) cited in `text`; null text gives an empty array."""
    whole = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(0))
    return F.transform(
        whole,
        lambda ref: F.struct(F.substring_index(ref, "/", 1).alias("kind"), F.regexp_replace(ref, "^[^/]*/", "").alias("name")),
    )


def strict_json(text: Column) -> Column:
    """`text` as a variant if all of it is one JSON value; null otherwise.

    The parser alone would take a valid beginning and leave the rest unread; as an element before another one the
    value must end where it should.
    """
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2
    return F.when(whole, F.try_parse_json(text))
