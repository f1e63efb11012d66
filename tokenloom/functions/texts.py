"""Text helpers: parts of names, escapes, numbers as shown, canonical JSON, merged property maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after_first(text: Column, mark: str) -> Column:
    """What follows the first mark; null where there is none."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def before_last(text: Column, n: int) -> Column:
    """All but the last n characters."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(0), F.length(text) - n))


def last(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def escaped(text: Column, marks: str) -> Column:
    """The marks as percent and two hex digits; a percent sign among them goes first."""
    out = text
    for m in sorted(marks, key=lambda c: c != "%"):
        out = F.replace(out, F.lit(m), F.lit(f"%{ord(m):02X}"))
    return out


def shown(number: Column) -> Column:
    """A count with separators, a dash if it isn't known."""
    return F.coalesce(F.format_number(number, 0), F.lit("-"))


def canonical(fields: dict[str, Column]) -> Column:
    """An object as compact JSON with sorted keys; null fields are left out."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))))


def merge_maps(rows: DataFrame, by: str, maps: str) -> DataFrame:
    """One row for each name in a group's property maps: its only value, or null and a conflict."""
    each = rows.select(by, F.explode(maps).alias("name", "value"))
    out = each.groupBy(by, "name").agg(F.min("value").alias("_a"), F.max("value").alias("_z"))
    return out.select(by, "name", F.when(F.col("_a") == F.col("_z"), F.col("_a")).alias("value"), (F.col("_a") != F.col("_z")).alias("conflict"))
