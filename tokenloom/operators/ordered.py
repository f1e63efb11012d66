"""Operators along an order: cumulative counters, as-of context, runs, buckets of time, unions of intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def counter_deltas(rows: DataFrame, stream: list[str], order: list[str], counter: str) -> DataFrame:
    """delta, event and epoch of a cumulative counter without nulls; a lower total starts an epoch and counts whole."""
    w = Window.partitionBy(*stream).orderBy(*order)
    before = F.lag(counter).over(w)
    reset = F.coalesce(F.col(counter) < before, F.lit(False))
    event = F.when(reset, "reset").when(F.col(counter) == before, "repeated").otherwise("advanced")
    out = rows.withColumns({"delta": F.when(reset | before.isNull(), F.col(counter)).otherwise(F.col(counter) - before), "event": event, "_reset": reset.cast("long")})
    return out.withColumn("epoch", F.sum("_reset").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_reset")


class Counters:
    """The last values and the epoch of a stream's counters, some of which a row may leave out.

    A measure left out keeps its last value within the epoch. If any reported one falls, all start anew.
    """

    def __init__(self, measures: list[str]):
        self.measures, self.last, self.epoch = measures, {}, 0

    def step(self, row: tuple) -> list:
        """The deltas of a row's measures, its event and its epoch."""
        now = {m: int(v) for m, v in zip(self.measures, row, strict=True) if not pd.isna(v)}
        event = "advanced"
        if any(v < self.last.get(m, 0) for m, v in now.items()):
            event, self.epoch, self.last = "reset", self.epoch + 1, {}
        elif all(self.last.get(m) == v for m, v in now.items()):
            event = "repeated"  # also a row that reports nothing
        deltas = {m: v - self.last.get(m, 0) for m, v in now.items()} if event != "repeated" else {}
        self.last = self.last | now
        return [*(deltas.get(m) for m in self.measures), event, self.epoch]


def running_totals(stream: pd.DataFrame, measures: list[str]) -> pd.DataFrame:
    """deltas, event and epoch of several counters at once, for the ordered rows of one stream."""
    counters = Counters(measures)
    out = [counters.step(row) for row in stream[measures].itertuples(index=False)]
    made = pd.DataFrame(out, columns=[*(f"delta_{m}" for m in measures), "event", "epoch"], index=stream.index)
    return pd.concat([stream, made.astype({f"delta_{m}": "Int64" for m in measures})], axis=1)


def grouped_counter_deltas(rows: DataFrame, stream: str, order: list[str], measures: list[str]) -> DataFrame:
    """running_totals for every stream: the baseline of a counter with gaps depends on all rows before it.

    Spark sorts (and spills) the streams; a task reads them batch by batch and holds the counters of one stream only.
    """
    made = [T.StructField(f"delta_{m}", T.LongType()) for m in measures]
    schema = T.StructType([*rows.schema.fields, *made, T.StructField("event", T.StringType()), T.StructField("epoch", T.IntegerType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = at = None
        for batch in batches:
            out = []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in (stream, *measures)), strict=True):
                if counters is None or key != at:
                    counters, at = Counters(measures), key
                out.append(counters.step(row))
            made = zip(*out, strict=True) if out else [()] * (len(measures) + 2)
            kinds = [pa.int64()] * len(measures) + [pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=names)

    places = [F.col(c).asc_nulls_last() for c in (stream, *order)]
    return rows.repartition(F.col(stream)).sortWithinPartitions(*places).mapInArrow(run, schema)


def in_force(uses: DataFrame, contexts: DataFrame, stream: list[str], order: str, values: list[str]) -> DataFrame:
    """Uses with the values of the last context before them in their stream (an as-of join), null where there is none.

    Both go through one shuffle and one sort; no pair of a use and a context is made.
    """
    held = F.struct(*(F.col(v) for v in values))
    kind = contexts.select(held.alias("_held"))
    both = uses.withColumns({"_held": F.lit(None).cast(kind.schema["_held"].dataType), "_use": F.lit(True)})
    both = both.unionByName(contexts.select(*stream, order, held.alias("_held"), F.lit(False).alias("_use")), allowMissingColumns=True)
    frame = Window.partitionBy(*stream).orderBy(order, "_use").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_last", F.last("_held", ignorenulls=True).over(frame)).filter("_use")
    return found.select(*(f"`{c}`" for c in uses.columns), *(F.col(f"_last.{v}").alias(v) for v in values))


def carry_forward(rows: DataFrame, stream: list[str], order: list[str], value: Column, to: str, inclusive: bool = False) -> DataFrame:
    """The last value that isn't null in the rows before (or up to) each row of its stream."""
    frame = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(frame))


def runs(rows: DataFrame, stream: list[str], order: list[str], value: str) -> DataFrame:
    """One row for each run of equal values: first and last place, length."""
    w = Window.partitionBy(*stream).orderBy(*order)
    start = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_start", start).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    return marked.groupBy(*stream, "run").agg(F.min_by(value, at).alias(value), F.min_by(order[-1], at).alias("first"), F.max_by(order[-1], at).alias("last"), F.count("*").alias("length"))


def busy_time(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Seconds that the union of each group's intervals takes."""
    before = F.max(end).over(Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.lit(0).cast("long"), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return rows.withColumn("_own", own).groupBy(*by).agg(F.sum("_own").alias("busy_seconds"), F.count("*").alias("intervals"))


def log_linear_bucket(value: Column, per_octave: int = 8) -> Column:
    """Bucket of a positive whole number: its power of two, then that many equal parts; 0 is bucket -1."""
    power = F.floor(F.log2(value.cast("double")) + F.lit(1e-12))
    return F.when(value <= 0, F.lit(-1).cast("long")).otherwise((power * per_octave + F.floor((value / F.pow(F.lit(2.0), power) - 1) * per_octave)).cast("long"))



def paired_neighbours(rows: DataFrame, stream: list[str], order: list[str], kind: Column, value: Column, section: Column | None = None) -> DataFrame:
    """Whether a row makes a pair with the row just before or just after it: the two are of different kinds, their values are
    equal (nulls pair with nothing) and they stand in the same section. A row makes one pair at most, with the earlier neighbour if it can.

    Rows that could pair with the next form runs; read from its start, a run pairs off its rows two by two.
    """
    w = Window.partitionBy(*stream).orderBy(*order)
    marked = rows.withColumns({"_kind": kind, "_value": value, "_section": section if section is not None else F.lit(0)})
    linked = (F.lag("_kind").over(w) != F.col("_kind")) & (F.lag("_value").over(w) == F.col("_value")) & (F.lag("_section").over(w) == F.col("_section"))
    runs = marked.withColumn("_starts", (~F.coalesce(linked, F.lit(False))).cast("long")).withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*stream, "_run")
    runs = runs.withColumns({"_place": F.row_number().over(run.orderBy(*order)), "_size": F.count("*").over(run)})
    return runs.withColumn("paired", (F.col("_place") % 2 == 0) | (F.col("_place") < F.col("_size"))).drop("_kind", "_value", "_section", "_starts", "_run", "_place", "_size")


def nearest_known(rows: DataFrame, stream: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """The value in force at each row, its own included; rows before the first take that one."""
    w = Window.partitionBy(*stream).orderBy(*order)
    return rows.withColumn("_known", value).withColumn(
        into, F.coalesce(F.last("_known", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_known", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    ).drop("_known")
