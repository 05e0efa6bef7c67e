"""Column expressions over text: tokens, words, sentences, and patterns built from word lists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number that doesn't follow a letter: optional sign, thousands, decimals, percent sign.
NUMBER = r"(?<![A-Za-z])-?\d+(?:,\d{3})*(?:\.\d+)?%?"
#: The same without thousands, as claims are checked with.
PLAIN_NUMBER = r"(?<![A-Za-z])-?\d+(?:\.\d+)?%?"
STOP_WORDS = sorted("a an and are as be by did does for from how in is it of on or that the their them they this to was were what which with".split())


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def content_tokens(c: Column) -> Column:
    """Distinct words of three characters or more that begin with a letter, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z0-9_-]{2,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def numbers(c: Column, pattern: str = NUMBER) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def parse_number(c: Column) -> Column:
    return F.regexp_replace(c, "[,%]", "").try_cast("double")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def words_pattern(phrases: Iterable[str], anywhere: Iterable[str] = ()) -> str:
    """A case-blind pattern of whole words or phrases, where a space stands for any white space; and of characters anywhere."""
    inside = "|".join(re.sub("(?<!-) ", r"\\s+", p) for p in phrases)  # the space of a class such as [- ] stays
    return r"(?i)\b(?:" + inside + r")\b" + "".join("|" + w for w in anywhere)


def first_seen(c: Column) -> Column:
    """The array's strings with later ones dropped that are equal but for case and white space; empty ones too."""
    norm = F.transform(c, lambda x: F.lower(squeeze(x)))
    kept = F.filter(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda i: (i <= F.size(c)) & (F.array_position(norm, F.get(norm, i - 1)) == i) & (F.get(norm, i - 1) != ""))
    return F.transform(kept, lambda i: F.get(c, (i - 1).cast("int")))
