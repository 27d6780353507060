"""Making extracted text uniform: characters, lines, letter-spaced headings, wrapped lines."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# What typographic characters become, and the bullets that become blanks.
PLAIN = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\u00a0": " ", "\ufeff": ""}
BULLETS = "•▪◦‣·∙●○–—"
_TABLE = {ord(k): v for k, v in PLAIN.items()}


@F.pandas_udf(StringType())
def nfkc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition; Spark has no builtin for it."""
    for series in values:
        yield series.map(lambda t: unicodedata.normalize("NFKC", t.translate(_TABLE)) if not t.isascii() else t, na_action="ignore")


def clean_line(line: Column) -> Column:
    flat = F.translate(F.regexp_replace(line, "\t", " "), BULLETS, " " * len(BULLETS))
    spaced = (F.length(flat) > 6) & flat.rlike(r"^(?:[A-Za-z] ){3,}[A-Za-z]\s*$")
    return F.trim(F.regexp_replace(F.when(spaced, F.regexp_replace(flat, " ", "")).otherwise(flat), " {2,}", " "))


def rejoin_wrapped(text: Column) -> Column:
    """Joins a line to the one before it (as merged so far) if that has 45 characters or more and ends in a small letter or a comma, and this one begins with a small letter."""

    before = lambda done: F.try_element_at(done, F.lit(-1))

    def fold(done: Column, line: Column) -> Column:
        wrapped = F.coalesce((F.length(before(done)) >= 45) & before(done).rlike(r"[\p{Ll},]$") & line.rlike(r"^\p{Ll}"), F.lit(False))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(wrapped, F.concat(head, F.array(F.concat_ws(" ", before(done), line)))).otherwise(F.concat(done, F.array(line)))

    return F.array_join(F.aggregate(F.split(text, "\n"), F.array().cast("array<string>"), fold), "\n")


def normalized(text: Column) -> Column:
    """All of it; null becomes the empty text."""
    plain = nfkc(F.coalesce(text, F.lit("")))
    joined = F.array_join(F.transform(F.split(plain, "\r\n|\r|\n"), clean_line), "\n")
    return F.regexp_replace(rejoin_wrapped(F.regexp_replace(joined, "\n{3,}", "\n\n")), r"^\s+|\s+$", "")
