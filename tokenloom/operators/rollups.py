"""Rollups of requests: totals, breakdowns, days, sessions, sizes, shares. Unknown groups stay groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.measures import MEASURES, cache_write, inclusive_input, total

STATUSES = ("owned", "ambiguous", "unknown")


def counts_by_status(status: str = "status") -> list[Column]:
    return [F.count_if(F.col(status) == s).alias(s) for s in STATUSES]


def measure_sums(measures: tuple[str, ...] = MEASURES) -> list[Column]:
    """Sums that skip what isn't reported: null if nothing is; an overflow is an error."""
    return [F.sum(m).alias(m) for m in measures]


def with_derived(sums: DataFrame) -> DataFrame:
    return sums.withColumns({"cache_write": cache_write(), "inclusive_input": inclusive_input(), "total": total()})


def local_date(instant: Column, zone: str) -> Column:
    """The civil date of a UTC instant (without zone) in a time zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant))


def daily(requests: DataFrame, instant: str, zone: str = "UTC", to: str = "date") -> DataFrame:
    """One row for each local date, and one for requests without an instant."""
    return with_derived(requests.groupBy(local_date(F.col(instant), zone).alias(to)).agg(*counts_by_status(), *measure_sums()))


def sessions(threads: DataFrame, requests: DataFrame, thread: str, owner: str, instant: str, zone: str = "UTC") -> DataFrame:
    """Every thread, also without requests: counts, sums, last date, and requests without an instant.

    Owners that are no known thread have a row too, and so have requests without an owner (a null thread).
    """
    usage = requests.groupBy(F.col(owner).alias("_owner")).agg(
        F.count("*").alias("requests"), *measure_sums(), F.max(local_date(F.col(instant), zone)).alias("last_date"), F.count_if(F.col(instant).isNull()).alias("undated_requests")
    )
    out = threads.join(usage, F.col(thread) == F.col("_owner"), "full").withColumn(thread, F.coalesce(thread, "_owner")).drop("_owner")
    return with_derived(out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("requests", "undated_requests")}))


def breakdowns(requests: DataFrame, dimensions: list[str]) -> DataFrame:
    """Independent breakdowns in one pass: (dimension, value, counts, sums); a missing value is `unknown`."""
    requests = requests.withColumns({d: F.coalesce(d, F.lit("unknown")) for d in dimensions})
    sets = ", ".join(f"({d})" for d in dimensions)
    sums = ", ".join(f"sum({m}) AS {m}" for m in MEASURES)
    kinds = ", ".join(f"count_if(status = '{s}') AS {s}" for s in STATUSES)
    name = " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dimensions)
    value = " ".join(f"WHEN grouping({d}) = 0 THEN {d}" for d in dimensions)
    return requests.sparkSession.sql(
        f"SELECT CASE {name} END AS dimension, CASE {value} END AS value, {kinds}, {sums} FROM {{requests}} GROUP BY GROUPING SETS ({sets})", requests=requests
    )


def components(requests: DataFrame, own: Column, parts: str) -> DataFrame:
    """One row for each part of each request; a request without parts is its own. Counts by part aren't additive."""
    return requests.select("*", F.inline(F.when(F.size(parts) > 0, F.col(parts)).otherwise(F.array(own))))


def totals(requests: DataFrame, counting: str = "counting", status: str = "status") -> DataFrame:
    """Counted requests by status, unresolved ones and copies, with completeness."""
    kinds = [F.count_if((F.col(counting) == "counted") & (F.col(status) == s)).alias(s) for s in STATUSES]
    rest = [F.count_if(F.col(counting) == c).alias(c) for c in ("unresolved", "copy_only")]
    sums = [F.sum(F.when(F.col(counting) == "counted", F.col(m))).alias(m) for m in MEASURES]
    unused = F.count_if((F.col(counting) == "counted") & F.coalesce(*MEASURES).isNull()).alias("without_usage")
    return requests.agg(*kinds, *rest, *sums, unused).withColumn("complete", (F.col("unresolved") == 0) & (F.col("without_usage") == 0))


def placement(candidates: str, selected: Column) -> Column:
    """Where a request is: inside if all its candidates are selected, possible if some are, else outside."""
    inside, known = F.size(F.array_intersect(candidates, selected)), F.size(F.array_distinct(candidates))
    return F.when((known == 0) | (inside == 0), "outside").when(inside == known, "inside").otherwise("possible")


def ranked_values(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Each group's known values (_v) with how often they occur (_n), the rank of their last (_upto), and the group's rows (_of).

    Values are counted before they are shuffled and sorted, so a group's rows are never held together; a sort may spill.
    """
    per = rows.select(*by, value.alias("_v")).filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("_upto", upto).withColumn("_of", F.sum("_n").over(group))


def sizes(requests: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Nearest-rank percentiles of the values that are known."""
    at = [F.min(F.when(F.col("_upto") * 100 >= F.col("_of") * p, F.col("_v"))).cast("long").alias(f"p{p}") for p in (50, 90, 99)]
    return ranked_values(requests, by, value).groupBy(*by).agg(F.sum("_n").alias("count"), *at, F.max("_v").alias("max"))


def medians(rows: DataFrame, by: list[str], value: Column, to: str) -> DataFrame:
    """The middle of each group's known values, or the mean of the two in the middle."""
    low, high = (F.min(F.when(F.col("_upto") * 2 >= F.col("_of") + i, F.col("_v"))).cast("double") for i in (0, 1))
    return ranked_values(rows, by, value).groupBy(*by).agg((low * 0.5 + high * 0.5).alias(to))


def joint(requests: DataFrame, row: Column, column: str, values: list[str], value: Column) -> DataFrame:
    """A sparse joint table: one row for each row key, one column for each listed value."""
    return requests.groupBy(row).pivot(column, values).agg(value)


def by_agent(requests: DataFrame, agent: str) -> DataFrame:
    """Totals of each agent and of all together (a null agent), in one pass."""
    grouped = requests.groupingSets([[F.col(agent)], []], F.col(agent)).agg(F.grouping(agent).alias("_all"), F.count("*").alias("requests"), *measure_sums())
    return grouped.withColumn(agent, F.when(F.col("_all") == 0, F.coalesce(agent, F.lit("unknown")))).drop("_all")


def completeness(requests: DataFrame, gaps: DataFrame, thread: str) -> DataFrame:
    """Threads with why their totals may be too small: requests without usage, unresolved or possible ones, gaps."""
    why = requests.groupBy(thread).agg(
        F.max((F.col("counting") == "counted") & F.coalesce(*MEASURES).isNull()).alias("without_usage"), F.max(F.col("counting") == "unresolved").alias("unresolved"), F.max(F.col("status") == "ambiguous").alias("possible")
    )
    out = why.join(gaps.select(F.col(thread).alias("_gap")).distinct(), F.col(thread) == F.col("_gap"), "left").withColumn("gap", F.col("_gap").isNotNull()).drop("_gap")
    names = ("without_usage", "unresolved", "possible", "gap")
    reasons = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))
    return out.select(thread, (F.size(reasons) == 0).alias("complete"), F.array_join(reasons, ",").alias("reasons"))


def page(rows: DataFrame, order: list[tuple[str, bool]], after: list | None, limit: int) -> DataFrame:
    """The rows that follow a cursor (the order's values of the last row seen), up to a limit; order pairs columns with `descending`."""
    if after is not None:
        past, same = F.lit(False), F.lit(True)
        for (c, down), v in zip(order, after, strict=True):
            past = past | same & (F.col(c) < F.lit(v) if down else F.col(c) > F.lit(v))
            same = same & (F.col(c) == F.lit(v))
        rows = rows.filter(past)
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order)).limit(limit)
