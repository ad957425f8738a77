"""Helpers shared by the corpus operators: words, sizes, null-safe joins, driver loops that end on one number."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a maximal run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; none for a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *columns: str) -> Column:
    """A repeatable pseudo-random long from the columns of a row."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns whose nulls are equal; the key columns of `left` stay."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"_on_{c}"])
    return left.join(renamed, condition, how).drop(*[f"_on_{c}" for c in on])


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """The columns that an operator is about to add must not be there yet: a caller's column of that name is dropped."""
    return df.drop(*[n for n in names if n in df.columns])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]
