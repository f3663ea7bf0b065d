"""String expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, digits and underscores; each Han sign, and each other sign that is not white space, by itself.
TOKEN = r"\p{IsHan}|[\p{L}\p{N}_&&[^\p{IsHan}]]+|[^\s\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1)


def count_of(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def json_reply(c: Column, schema: str | None = None) -> Column:
    """A model's JSON answer, with or without a Markdown fence; null if it doesn't parse."""
    bare = F.regexp_replace(strip(c), r"(?is)^```[a-z]*\s*|\s*```$", "")
    return F.from_json(bare, schema) if schema else F.try_parse_json(bare)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; null if one has norm 0 or their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))
