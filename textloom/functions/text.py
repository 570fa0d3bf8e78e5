"""Text as lines, needles and identifiers: column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_array(text: str | Column) -> Column:
    """The lines of a text; a line feed at its end opens no further line, an empty text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\r?\n"))


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """A row for each line: the kept columns, line_no (from 1) and line."""
    found = files.select(*keep, F.posexplode(line_array("text")).alias("at", "line"))
    return found.select(*keep, (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def ascii_lower(text: str | Column) -> Column:
    """Lower case of the ASCII letters only; other letters stay as they are."""
    return F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER)


def ascii_fold(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def has(text: Column, needle: str, ignore_case: bool = True) -> Column:
    return F.contains(ascii_lower(text), F.lit(ascii_fold(needle))) if ignore_case else F.contains(text, F.lit(needle))


def has_any(text: Column, needles: list[str], ignore_case: bool = True) -> Column:
    return reduce(lambda a, b: a | b, [has(text, n, ignore_case) for n in needles])


def count_sub(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a needle."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def identifier(text: Column) -> Column:
    """Letters and digits in lower case, for loose equality of names."""
    return F.regexp_replace(ascii_lower(text), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def shorten(text: Column, most: int = 140) -> Column:
    """Trimmed and cut by characters, with three dots where something was cut."""
    bare = F.trim(text)
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("..."))).otherwise(bare)


def joined(items: Column, by: str = ",") -> Column:
    return F.array_join(items, by)
