"""Joins whose keys may be hot or missing, and joins of intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with so many rows of the larger side, and that share of them, is dealt over so many tasks.
HOT, HOT_SHARE, SALTS = 10_000, 1e-4, 64


def dealt_join(large: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """large joined to small on columns; the rows of hot keys are dealt over SALTS tasks by `spread`, and only their rows of small are copied as often.

    No more than 1 / HOT_SHARE keys can be hot, whatever the tables, so the list of them is broadcast. Rows of large without a key match
    nothing and are dealt over as many tasks.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))
    keyed = large.filter(known) if how in ("inner", "left_semi") else large
    counts = large.filter(known).groupBy(*on).agg(F.count("*").alias("_n"))
    rows, most = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    least = max(HOT, int(rows * HOT_SHARE))
    spread = F.pmod(spread, F.lit(SALTS)).cast("int")
    if most < least:
        left, right = keyed.withColumn("_salt", F.when(known, 0).otherwise(spread)), small.withColumn("_salt", F.lit(0))
    else:
        hot = F.broadcast(counts.filter(F.col("_n") >= least).select(*on, F.lit(True).alias("_hot")))
        left = keyed.join(hot, on, "left").withColumn("_salt", F.when(known & F.col("_hot").isNull(), 0).otherwise(spread)).drop("_hot")
        right = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0)))).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: tuple[str, str], end: tuple[str, str], cell: int) -> DataFrame:
    """Pairs of the same key whose intervals [start, end) share a place; starts and ends are whole numbers, and an interval without a place pairs with nothing.

    Time is cut into cells of `cell` and its doubles, level by level. An interval lives on the level whose cells are at least as long as it is, so
    it lies in two cells at most; a pair is looked for on the higher of both levels, and found once: in the cell of the later start. Work grows with
    the rows, the levels that occur (a few numbers that the driver reads) and the pairs there are, not with the product of the sides. Hot cells are dealt over tasks.
    """

    def marked(rows: DataFrame, i: int, side: str) -> DataFrame:
        rows = rows.filter(F.col(end[i]) > F.col(start[i]))
        level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end[i]) - F.col(start[i])) / F.lit(float(cell))) - F.lit(1e-9))).cast("int")
        return rows.select(*keys, F.struct("*").alias(side), F.col(start[i]).cast("long").alias(f"_s{i}"), F.col(end[i]).cast("long").alias(f"_e{i}"), level.alias(f"_l{i}"))

    sides = marked(left, 0, "_left"), marked(right, 1, "_right")
    levels = [sorted(r[0] for r in s.select(f"_l{i}").distinct().collect()) for i, s in enumerate(sides)]  # 64 at most

    def celled(rows: DataFrame, i: int) -> DataFrame:
        # its own level, and the higher ones of the other side
        at = F.array_distinct(F.concat(F.array(F.col(f"_l{i}")), F.filter(F.array(*(F.lit(x) for x in levels[1 - i])), lambda x: x > F.col(f"_l{i}"))))
        rows = rows.withColumn("_level", F.explode(at)).withColumn("_size", F.lit(cell).cast("long") * F.expr("shiftleft(1L, _level)"))
        first, last = F.floor(F.col(f"_s{i}") / F.col("_size")), F.floor((F.col(f"_e{i}") - 1) / F.col("_size"))
        return rows.withColumn("_cell", F.explode(F.sequence(first, last)))

    if not all(levels):
        a, b = (s.select(*(F.col(f"{n}.{c}") for c in d.columns if n == "_left" or c not in keys)).limit(0) for s, d, n in zip(sides, (left, right), ("_left", "_right"), strict=True))
        return a.join(b.withColumn("_none", F.lit(1)), F.lit(False)).drop("_none")
    a, b = celled(sides[0], 0), celled(sides[1], 1).drop("_size")
    found = dealt_join(a, b, [*keys, "_level", "_cell"], F.xxhash64("_s0", "_e0"))
    later = F.greatest("_s0", "_s1")
    found = found.filter((F.col("_level") == F.greatest("_l0", "_l1")) & (F.col("_s0") < F.col("_e1")) & (F.col("_s1") < F.col("_e0")) & (F.col("_cell") == F.floor(later / F.col("_size"))))
    return found.select(*(F.col(f"_left.{c}") for c in left.columns), *(F.col(f"_right.{c}") for c in right.columns if c not in keys))


def recorded_windows(limits: DataFrame, resets: str = "resets_at", minutes: str = "window_minutes", to: tuple[str, str] = ("starts", "ends")) -> DataFrame:
    """Quota observations with the window that each records, as seconds [starts, ends); one that lacks either figure records none and is left out."""
    rows = limits.filter(F.col(resets).isNotNull() & (F.col(minutes) > 0))
    return rows.withColumns({to[0]: (F.col(resets) - F.col(minutes) * 60).cast("long"), to[1]: F.col(resets).cast("long")})


def in_windows(requests: DataFrame, windows: DataFrame, keys: list[str], instant: str, starts: str = "starts", ends: str = "ends", cell: int = 3600) -> DataFrame:
    """Each request (its instant in whole seconds) with every recorded window that it falls in; windows are never inferred."""
    timed = requests.withColumn("_until", F.col(instant) + 1)
    return overlap_join(timed, windows, keys, (instant, starts), ("_until", ends), cell).drop("_until")


def merged(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals [start, end) that cover the same places; touching ones become one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.filter(F.col(end) > F.col(start)).withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    return marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def extent_relation(ours: DataFrame, theirs: DataFrame, by: list[str], start: str = "begin", end: str = "end", cell: int = 1 << 20) -> DataFrame:
    """(by, relation) of each source in theirs: `covered` if ours has all of its extents, `disjoint` if none, else `partial`."""
    mine, other = merged(ours, by, start, end), merged(theirs, by, start, end)
    both = overlap_join(other, mine.withColumnsRenamed({start: "_from", end: "_to"}), by, (start, "_from"), (end, "_to"), cell)
    shared = both.groupBy(*by).agg(F.sum(F.least(end, "_to") - F.greatest(start, "_from")).alias("_shared"))
    size = other.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("_size"))
    relation = F.when(F.col("_shared").isNull(), "disjoint").when(F.col("_shared") == F.col("_size"), "covered").otherwise("partial")
    return size.join(shared, by, "left").select(*by, relation.alias("relation"))
