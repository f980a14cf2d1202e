"""Labels and texts: normal form, tokens, character bigrams, paging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def normalize_label(c: Column) -> Column:
    """Fullwidth forms to ASCII, lower case, runs of white space to one blank, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, _WIDE, _NARROW)), r"(?U)\s+", " "))


def _windows(run: Column, n: int = 2) -> Column:
    return F.when(F.length(run) < n, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - n + 1)), lambda i: F.substring(run, i, F.lit(n))))


def tokens(c: Column) -> Column:
    """Words of ASCII letters and digits; bigrams of other letters and digits, a single one as it is; in no order, with repeats."""
    runs = F.regexp_extract_all(normalize_label(c), F.lit(r"([a-z0-9]+|[\p{L}\p{N}&&[^a-z0-9]]+)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9]"), F.array(r)).otherwise(_windows(r))))


def grams(c: Column) -> Column:
    """Different bigrams of every run of letters and digits, sorted."""
    runs = F.regexp_extract_all(normalize_label(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: _windows(r)))))


def all_tokens_in(query: str, doc_tokens: Column, spark_query: Column | None = None) -> Column:
    """Whether all tokens of a query are among those of a text; a query without tokens filters nothing."""
    q = tokens(spark_query if spark_query is not None else F.lit(query))
    return F.forall(q, lambda t: F.array_contains(doc_tokens, t))


def page(body: Column, start: int, length: int) -> Column:
    """Bytes [start, start + length) of a binary, ending on a whole UTF-8 character (at least one)."""
    raw = F.substring(body, start + 1, length)
    cut = raw
    for k in (1, 2, 3):
        cut = F.when(F.is_valid_utf8(cut.cast("string")), cut).otherwise(F.substring(raw, 1, length - k))
    return cut


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))
