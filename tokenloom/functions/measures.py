"""Token measures: null means "not reported", which is not zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In the order in which measures are compared and stored.
MEASURES = ("uncached_input", "cache_read", "cache_write_5m", "cache_write_1h", "cache_write_unspecified", "output", "reasoning", "provider_only")
CACHE_WRITES = MEASURES[2:5]
INPUTS = MEASURES[:5]
#: Reasoning is part of output, so it isn't in the total.
IN_TOTAL = tuple(m for m in MEASURES if m != "reasoning")


def sum_known(*values: Column) -> Column:
    """The sum of the values that are reported; null if none is."""
    total = reduce(lambda a, b: a + b, (F.coalesce(v, F.lit(0).cast("long")) for v in values))
    return F.when(F.coalesce(*values).isNotNull(), total)


def _columns(names: tuple[str, ...], usage: str | None) -> list[Column]:
    return [F.col(f"{usage}.{n}" if usage else n) for n in names]


def cache_write(usage: str | None = None) -> Column:
    return sum_known(*_columns(CACHE_WRITES, usage))


def inclusive_input(usage: str | None = None) -> Column:
    return sum_known(*_columns(INPUTS, usage))


def total(usage: str | None = None) -> Column:
    return sum_known(*_columns(IN_TOTAL, usage))


def without_cache(native: Column, read: Column, write: Column) -> Column:
    """Uncached input where the native figure includes the cache; null where the cache is larger than the input."""
    rest = native - F.coalesce(read, F.lit(0)) - F.coalesce(write, F.lit(0))
    return F.when(rest >= 0, rest)


def split_writes(flat: Column, five: Column, hour: Column) -> Column:
    """Cache writes by lifetime if the parts add up to the flat total, else all of them unspecified."""
    agree = sum_known(five, hour).eqNullSafe(flat) | flat.isNull()
    null = F.lit(None).cast("long")
    return F.struct(F.when(agree, five).otherwise(null).alias("cache_write_5m"), F.when(agree, hour).otherwise(null).alias("cache_write_1h"), F.when(agree, null).otherwise(flat).alias("cache_write_unspecified"), (~agree).alias("mismatch"))


def whole_number(value: Column) -> Column:
    """A JSON number as a count: whole and not negative, up to 2^53 if written with a point; else null."""
    exact = value.try_cast("decimal(38,6)")
    return F.when((exact >= 0) & (exact == F.floor(exact)), exact.try_cast("long"))


def counts_only(line: Column) -> Column:
    """A JSON line in which text in place of a count is null: a parser of decimals would take it for a number."""
    return F.regexp_replace(line, r'"([a-z0-9_]+_tokens|apiBlockIndex|ordinal)"\s*:\s*"[^"\\]*"', '"$1":null')


MOST = (1 << 63) - 1


def saturating(total: Column) -> Column:
    """A sum of counts that stops at the largest count instead of failing; sums of counts as decimals never overflow on the way."""
    return F.when(total.isNotNull(), F.least(total, F.lit(MOST).cast("decimal(38,0)"))).cast("long")


def saturating_sum(count: Column) -> Column:
    """The sum over a group's known counts, the largest count where it is above that; null if none is known."""
    return saturating(F.sum(count.cast("decimal(20,0)")))


def ceil_div(count: Column, by: int) -> Column:
    """A count divided and rounded up, in whole numbers."""
    if by < 1:
        raise ValueError(f"division by {by}")
    whole = F.call_function("div", count, F.lit(by)).cast("long")
    return whole + F.when(count > whole * by, 1).otherwise(0)
