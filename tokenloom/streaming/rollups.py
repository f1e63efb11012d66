"""Streams of requests: buckets of event time with a watermark, undated requests, revisions and running totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenloom.functions.measures import MEASURES
from tokenloom.operators.ordered import Counters


def buckets(requests: DataFrame, instant: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Requests and sums of each bucket; a bucket is final once the watermark has passed it."""
    dated = requests.filter(F.col(instant).isNotNull()).withWatermark(instant, late)
    sums = [F.sum(m).alias(m) for m in MEASURES if m in requests.columns]
    return dated.groupBy(F.window(instant, width).alias("_w")).agg(F.count("*").alias("requests"), *sums).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "requests", *(m for m in MEASURES if m in requests.columns))


def undated(requests: DataFrame, instant: str) -> DataFrame:
    """Requests without an instant, which a watermark would drop."""
    return requests.filter(F.col(instant).isNull())


def latest_revisions(rows: DataFrame, by: list[str], order: Column, values: list[str]) -> DataFrame:
    """The values of each set's greatest revision so far, and how many there were: a later one replaces what was sent
    before (update mode). A revision may come at any time, so the state keeps one row for each set."""
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*values), order).alias("_picked"), F.count("*").alias("revisions"))
    return picked.select(*by, "_picked.*", "revisions")


def running_totals(rows: DataFrame, stream: str, order: list[str], measures: list[str]) -> DataFrame:
    """Deltas, event and epoch of cumulative counters, which go on from batch to batch (append mode).

    The state of a stream is its epoch and last values. A batch's rows of one stream are sorted in its task, so a batch should
    be bounded (`maxFilesPerTrigger`); rows that come in a later batch come later, whatever their order columns say.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    deltas = [f"delta_{m}" for m in measures]
    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in (stream, *order)), *(f"`{c}` bigint" for c in deltas), "event string", "epoch int"])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counters = Counters(measures)
        if state.exists:
            counters.epoch, last = state.get
            counters.last = {m: int(v) for m, v in zip(measures, last, strict=True) if v is not None}
        held = pd.concat(list(frames)).sort_values(order, kind="stable")
        made = [counters.step(row) for row in held[measures].itertuples(index=False)]
        state.update((counters.epoch, [str(counters.last[m]) if m in counters.last else None for m in measures]))
        found = pd.DataFrame(made, columns=[*deltas, "event", "epoch"], index=held.index).astype(dict.fromkeys(deltas, "Int64"))
        yield pd.concat([held[[stream, *order]], found], axis=1)

    # counts pass as text: pandas would make numbers with gaps floats, which end at 2^53
    texts = rows.select(stream, *order, *(F.col(m).cast("string").alias(m) for m in measures))
    return texts.groupBy(stream).applyInPandasWithState(step, out, "epoch int, last array<string>", "append", GroupStateTimeout.NoTimeout)
