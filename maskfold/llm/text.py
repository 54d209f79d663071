"""Column expressions on whole texts that several operators share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII blanks; none for null and blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have yet, so that helper columns never clash."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
