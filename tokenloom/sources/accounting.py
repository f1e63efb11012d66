"""Which of a rollout's usage counts, and whose it is.

Three steps, each over all files at once.

1. `with_roles`: what a file is as a whole, by windows over it. A file without usage records leaves its usage to its counters (scope `all`). Where
   it has records, they count; beside them a file that can hold nobody else's history (`mixed`) also counts those counters that no
   record accounts for: neither the twin of the record before or after it in its turn, nor a counter that brings nothing new after such usage. Elsewhere
   (`direct`) no counter counts.
2. `with_evidence`: what other files say. The turns and the totals that complete roots recorded are joined to the turns and totals of files that
   name them, so a row knows whether its parent has it.
3. `observe`: an ordered pass over each file, which Spark sorts; it holds the state of one file. It says whose each line is (names, a boundary,
   else the parent's turns), continues the counters' running total, and proves the first step after an inherited total. What can't be proved
   is a gap, never usage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tokenloom.operators.ordered import nearest_known, paired_neighbours
from tokenloom.sources.rollouts import COUNTS

#: Kinds of lines that bear usage.
_RECORD, _COMPACTED, _COUNTER = "token_usage_record", "compacted", "token_count"


def _file(first: int | None = None, last: int | None = None) -> WindowSpec:
    """The rows of a file; with ends, those from and to so many rows from the current one."""
    w = Window.partitionBy("locator")
    return w if first is None else w.orderBy("offset").rowsBetween(first, last)


def _to_here(offset: int = 0) -> WindowSpec:
    return _file(Window.unboundedPreceding, offset)


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _reported(usage: str) -> Column:
    return F.coalesce(*(F.col(f"{usage}.{c}") for c in COUNTS)).isNotNull()


def signature(usage: str, missing: str = "?") -> Column:
    """The counts as one text; null where none is reported."""
    return F.when(_reported(usage), F.concat_ws(":", *(F.coalesce(F.col(f"{usage}.{c}").cast("string"), F.lit(missing)) for c in COUNTS)))


def with_roles(rows: DataFrame) -> DataFrame:
    """Typed rows with what their file is as a whole (`file`), the counters' `role` (counted, twin or covered) and `lone`, which says of a compacted line that it alone keeps its response."""
    own_meta = _is("session_meta") & F.col("id").eqNullSafe(F.col("file_thread"))
    other_meta = _is("session_meta") & ~F.col("id").eqNullSafe(F.col("file_thread"))
    lineage = other_meta | (_is("session_meta") & (F.col("parent").isNotNull() | F.col("boundary").isNotNull() | F.col("boundary_invalid")))
    names_other = F.col("kind").isin("thread_settings_applied", _RECORD) & (F.col("thread_id") != F.col("file_thread"))
    ever = lambda condition: F.coalesce(F.max(condition).over(_file()), F.lit(False))
    first = lambda condition, value: F.first(F.when(condition, value), True).over(_file(Window.unboundedPreceding, Window.unboundedFollowing))
    meta = first(own_meta, F.struct("parent", "boundary", "boundary_invalid", "paginated", "based", "subagent"))
    facts = rows.withColumns(
        {
            "_records": ever(_is(_RECORD)), "_single": ~ever(lineage | names_other), "_lineage": ever(lineage | F.col("nested")), "_foreign": ever(other_meta & F.col("id").isNotNull()), "_meta": meta,
            "_root": F.coalesce(first(_is("session_meta"), own_meta & F.col("parent").isNull()), F.lit(False)), "_last_ordinal": F.max("ordinal").over(_file()),
            "_own": F.max(_is(_RECORD) & (F.col("thread_id") == F.col("file_thread"))).over(Window.partitionBy("locator", "response_id")),
            "_before": F.last(F.when(_is(_COUNTER), signature("total")), True).over(_to_here(-1)), "_turns": F.count_if(_is("turn_context")).over(_to_here()),
        }
    )
    moved = _is(_COUNTER) & _reported("total") & ~signature("total").eqNullSafe(F.col("_before"))
    brings = moved & ((F.coalesce(F.col("last.input_tokens"), F.lit(0)) > 0) | (F.coalesce(F.col("last.output_tokens"), F.lit(0)) > 0))
    facts = facts.withColumn("_event", _is(_RECORD) | brings)
    said = F.when(_is(_RECORD), signature("usage")).otherwise(signature("last"))
    pairs = paired_neighbours(facts.filter("_event"), ["locator"], ["offset"], F.col("kind"), said, F.col("_turns")).select("locator", "offset", "paired")
    facts = facts.join(pairs, ["locator", "offset"], "left")
    # what a counter without news follows: usage that records account for, or usage that counters do
    accounts = F.when(F.col("_event"), F.when(_is(_RECORD) | F.col("paired"), "covered").otherwise("counted"))
    facts = nearest_known(facts, ["locator"], ["offset"], accounts, "_follows")
    role = F.when(F.col("_event"), F.when(F.col("paired"), "twin").otherwise("counted")).otherwise(F.coalesce("_follows", F.lit("covered")))
    any_counted = ever(accounts == "counted")
    scope = F.when(~F.col("_records"), "all").when(F.col("_single") & any_counted, "mixed").otherwise("direct")
    facts = facts.withColumn("_scope", scope)
    declared = F.col("_meta.boundary").isNotNull() | F.coalesce(F.col("_meta.boundary_invalid"), F.lit(False))
    unmarked = (F.col("_scope") == "all") & ~F.col("_foreign") & ~declared & F.coalesce(F.col("_meta.paginated"), F.lit(False)) & F.col("_meta.parent").isNotNull() & ~F.col("_meta.based") & ~F.col("_meta.subagent")
    file = F.struct(
        F.col("_scope").alias("scope"), F.col("_root").alias("root"), F.col("_lineage").alias("lineage"), F.col("_foreign").alias("foreign"), F.col("_meta.parent").alias("parent"), F.col("_meta.boundary").alias("boundary"),
        F.coalesce(F.col("_meta.boundary_invalid"), F.lit(False)).alias("boundary_invalid"), F.coalesce(unmarked, F.lit(False)).alias("unmarked"), (F.coalesce("_last_ordinal", F.lit(-1)) < F.col("_meta.boundary")).alias("unreached"),
    )
    lone = _is(_COMPACTED) & (F.col("thread_id") == F.col("file_thread")) & F.col("response_id").isNotNull() & ~F.coalesce("_own", F.lit(False))
    own = [c for c in rows.columns]
    return facts.select(*own, file.alias("file"), F.when(_is(_COUNTER), F.when(F.col("_scope") == "mixed", role).when(F.col("_scope") == "all", "counted").otherwise(role)).alias("role"), F.coalesce(lone, F.lit(False)).alias("lone"))


def with_evidence(rows: DataFrame) -> DataFrame:
    """Rows of `with_roles` with `recorded`: whether the thread that they may have been copied from recorded their turn or total. Null where nothing can tell.

    A file that holds another thread's header asks the root that it names last; any other asks its parent, which must be complete: none of its files holds lineage.
    """
    total = signature("total", "0")
    threads = rows.groupBy(F.col("file_thread").alias("thread")).agg(F.max("file.root").alias("root"), (F.max("file.root") & ~F.max("file.lineage")).alias("complete")).filter("root")
    roots = rows.filter("file.root")
    key = F.when(_is("turn_context"), F.concat(F.lit("turn:"), "turn")).when(_is(_COUNTER) & (F.col("file.scope") == "all"), F.concat(F.lit("total:"), total))
    known = roots.select(F.col("file_thread").alias("thread"), key.alias("key")).filter("key IS NOT NULL").distinct().withColumn("has", F.lit(True))
    named = F.when(_is("session_meta"), F.col("id")).when(_is("thread_settings_applied"), F.coalesce("thread_id", "file_thread")).when(F.col("kind").isin(_RECORD, _COMPACTED), F.col("thread_id"))
    asking = rows.withColumn("_named", F.last(named, True).over(_to_here()))
    foreign = F.col("file.foreign")
    asking = asking.select("locator", "offset", F.when(foreign, F.when(_is("turn_context") & (F.col("file.scope") == "all"), F.col("_named"))).otherwise(F.col("file.parent")).alias("thread"), key.alias("key"), foreign.alias("_foreign"))
    asking = asking.filter("thread IS NOT NULL AND key IS NOT NULL").join(threads, "thread").filter("_foreign OR complete")
    answers = asking.join(known, ["thread", "key"], "left").select("locator", "offset", F.coalesce("has", F.lit(False)).alias("recorded"))
    return rows.join(answers, ["locator", "offset"], "left")


def copied_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(locator, copied): complete lines in stretches that another thread's header opens, in files whose copied history nothing else marks. A turn that the other thread never recorded ends a stretch, or settings do."""
    legacy = rows.filter("file.scope = 'all' AND file.foreign AND file.parent IS NOT NULL AND file.boundary IS NULL AND NOT file.boundary_invalid")
    ends = _is("thread_settings_applied") | (_is("turn_context") & ~F.coalesce("recorded", F.lit(True)))
    marks = legacy.select("locator", "offset", F.when(_is("session_meta"), F.col("id") != F.col("file_thread")).when(ends, F.lit(False)).alias("_copied")).filter("_copied IS NOT NULL")
    both = lines.filter("state = 'record'").select("locator", "offset").join(legacy.select("locator").distinct(), "locator", "left_semi").join(marks, ["locator", "offset"], "left")
    return both.withColumn("_copied", F.last("_copied", True).over(_to_here())).groupBy("locator").agg(F.count_if("_copied").alias("copied")).filter("copied > 0")


class BelowCache(ValueError):
    """An input smaller than the part of it that came from the cache."""


MEASURED = ("uncached_input", "cache_read", "cache_write_unspecified", "output", "reasoning")
Usage = dict[str, int]


def measures(usage: dict) -> Usage:
    """The measures that a usage reports."""
    whole, read, write = (usage[c] for c in COUNTS[:3])
    rest = None if whole is None else whole - (read or 0) - (write or 0)
    if rest is not None and rest < 0:
        raise BelowCache
    values = zip(MEASURED, (rest, read, write, usage["output_tokens"], usage["reasoning_output_tokens"]), strict=True)
    return {m: v for m, v in values if v is not None}


def _alike(a: Usage, b: Usage) -> bool:
    """Equal, what is not reported being nothing."""
    return all(a.get(m, 0) == b.get(m, 0) for m in MEASURED)


def _any(usage: dict | None) -> bool:
    return usage is not None and any(usage[c] is not None for c in COUNTS)


class Meter:
    """A running total. `base` is the total that the next step goes on from but hasn't been proved to; `last` the one it is at."""

    def __init__(self):
        self.last: Usage | None = None
        self.base: Usage | None = None
        self.suspect, self.epoch = False, 0

    def compared(self, total: Usage) -> str:
        before = self.last if self.last is not None else self.base or {}
        if any(v < before.get(m, v) for m, v in total.items()):
            return "fell"
        return "same" if all(before.get(m) == v for m, v in total.items()) else "rose"

    def step(self, total: Usage) -> tuple[str, Usage]:
        """What the total did, and by how much it rose."""
        did, before = self.compared(total), self.last if self.last is not None else self.base or {}
        self.epoch += did == "fell"
        self.last = total if did == "fell" else before | total
        return did, {m: v - before.get(m, 0) for m, v in total.items()} if did == "rose" else {}

    def proved(self, total: Usage, last: Usage | None) -> str:
        """A first step: `continued`, or `unseeded` if the total is its own usage alone, `repeated`, `lowered` or `unverified`."""
        if last is None:
            return "continued"
        before = self.base or {}
        did = self.compared(total)
        alone = _alike(total, last)
        if did == "same":
            return "repeated"
        if did == "fell":
            return "continued" if alone else "lowered" if _alike(last, {}) else "unverified"
        if _alike({m: v - before.get(m, 0) for m, v in total.items()}, last):
            return "continued"
        return "unseeded" if alone else "unverified"

    def lose(self, base: Usage | None, suspect: bool = True) -> None:
        """The next step must prove itself against a base (none: what was reached)."""
        base = base if base is not None else self.last
        self.base, self.last, self.suspect = base if base is not None else self.base, None, suspect or self.suspect


class Whose:
    """Whose the lines of a file are: the thread that a line names last, its parent's before a boundary, or undecided (None)."""

    def __init__(self, file_thread: str, file: dict, seeded: bool):
        self.own, self.parent, self.scope = file_thread, file["parent"], file["scope"]
        self.boundary, self.invalid, self.foreign = file["boundary"], file["boundary_invalid"], file["foreign"]
        self.unmarked = file["unmarked"] and not seeded
        self.unreached = self.unmarked or bool(file["unreached"])
        self.by_turns = self.scope == "all" and not self.foreign and not self.invalid and (self.boundary is not None or self.unmarked)
        self.active, self.claimed, self.prefix = file_thread, False, None  # claimed: a line said that what follows is this file's
        self.inferred, self.refuted, self.base = False, False, None

    def early(self, e: dict) -> bool:
        return self.unmarked or (self.boundary is not None and e["ordinal"] is not None and e["ordinal"] < self.boundary)

    def past(self, e: dict) -> bool:
        return self.boundary is not None and e["ordinal"] is not None and e["ordinal"] >= self.boundary

    def contradicts(self, e: dict, total: Usage | None) -> bool:
        """Whether the line shows that what was taken for this file's own still is copied history."""
        names = e["id"] if e["kind"] == "session_meta" else None if e["kind"] in ("turn_context", _COUNTER) else e["thread_id"]
        if names is not None and names != self.own:
            return True
        repeats = e["kind"] == _COUNTER and self.base is not None and total is not None and _alike(total, self.base)
        return bool(e["recorded"]) and not repeats and e["kind"] in ("turn_context", _COUNTER)

    def read(self, e: dict, total: Usage | None) -> tuple[str | None, bool, bool]:
        """(owner, whether it is undecided, whether an inferred start has just been refuted), before the line's own names take effect."""
        refuted = False
        if self.past(e):
            self.active = self.own
        if self.inferred:
            if self.past(e):
                self.inferred = False
            elif self.contradicts(e, total):
                self.inferred, self.refuted, self.claimed, self.prefix, refuted = False, True, False, "unplaced", True
        inherited = self.early(e) and self.active == self.own and not self.claimed
        copied = e["kind"] == _COUNTER and bool(e["recorded"]) and not self.foreign
        undecided = inherited and not self.foreign and self.prefix != "parent" and not copied and (self.unreached or self.prefix == "unplaced")
        nowhere = self.invalid or (self.boundary is not None and e["ordinal"] is None)
        return self.parent if inherited else self.active, undecided or nowhere, refuted

    def follow(self, e: dict, base: Usage | None) -> None:
        """What the line says of those after it."""
        kind, thread = e["kind"], e["id"] if e["kind"] == "session_meta" else e["thread_id"]
        if kind == "session_meta":
            if thread is not None:
                self.active, self.claimed, self.inferred = thread, False, False
        elif kind == "turn_context":
            if self.scope == "all" and self.active != self.own and self.foreign and e["recorded"] is False:
                self.active = self.own
            if self.by_turns and not self.refuted and self.early(e) and self.active == self.own and not self.claimed:
                if e["turn"] is None or e["recorded"] is None:
                    self.prefix = "unplaced"
                elif e["recorded"]:
                    self.prefix = "parent"
                else:
                    self.claimed = self.inferred = True
                    self.base = base
        elif kind == "thread_settings_applied":
            self.active = thread or self.own
            if thread is not None or not self.inferred:
                self.claimed = thread == self.own
            self.inferred = self.inferred and thread is None
        elif kind in (_RECORD, _COMPACTED) and thread is not None:
            self.active, self.claimed, self.inferred = thread, thread == self.own, False


class Pass:
    """The rows that a file's lines give: usage (originals and copies), gaps and diagnostics."""

    def __init__(self, e: dict, seeded: bool):
        self.file, self.scope = e["file_thread"], e["file"]["scope"]
        self.whose, self.meter = Whose(self.file, e["file"], seeded), Meter()
        self.inherits = e["file"]["parent"] is not None or e["file"]["boundary"] is not None or e["file"]["boundary_invalid"] or e["file"]["foreign"]
        self.turn, self.responses = None, {}
        self.kept, self.unread, self.total = None, None, None  # a compacted original's usage whose counter may follow; the last step that couldn't be read; the last total read
        self.accounted, self.check_dropped = {}, False
        self.held: list[dict] = []  # rows since an inferred start that may still be refuted

    def step(self, e: dict) -> list[dict]:
        out: list[dict] = []
        try:
            total = measures(e["total"]) if e["kind"] == _COUNTER and _any(e["total"]) else None
        except BelowCache:
            total = None
        waiting = self.whose.inferred
        owner, unplaced, refuted = self.whose.read(e, total)
        if refuted:  # own steps since the start are undecided after all
            for row in self.held:
                if row["what"] == "usage" and not row["copy"]:
                    out.append(row | {"what": "gap", "code": "boundary-unverified", "owner": None, "copy": None, **dict.fromkeys(MEASURED)})
                elif row["what"] != "diagnostic":
                    out.append(row)
            self.held = []
            self.meter.base, self.meter.last = self.total if self.total is not None else self.meter.base, None
        elif waiting and not self.whose.inferred:
            out, self.held = self.held, []
        base = self.meter.base
        if e["kind"] == "session_meta":
            if e["id"] == self.file and e["boundary_invalid"]:
                out.append(self._row(e, "diagnostic", "boundary-invalid"))
        elif e["kind"] == "turn_context":
            self.turn = e["turn"]
        elif e["kind"] in (_RECORD, _COMPACTED):
            out += self._record(e, owner, unplaced)
        elif e["kind"] == _COUNTER:
            out += self._counter(e, owner, unplaced)
        self.whose.follow(e, base)
        if self.whose.inferred:
            self.held += out
            return []
        out, self.held = self.held + out, []
        return out

    def end(self) -> list[dict]:
        return self.held

    def _record(self, e: dict, owner: str | None, unplaced: bool) -> list[dict]:
        """A record names its thread, which decides; an unnamed one goes by its place."""
        compacted = e["kind"] == _COMPACTED
        if compacted and e["thread_id"] is None and e["response_id"] is None and not _any(e["usage"]):
            return []
        out, placed = [], owner
        if not compacted and unplaced and e["thread_id"] is None and self.whose.active == self.file:
            out, placed = [self._row(e, "gap", "boundary-unverified")], None
        thread = e["thread_id"] or placed
        if e["response_id"] and thread:
            self.responses[thread] = e["response_id"]
        original = e["lone"] if compacted else thread == self.file
        key = e["response_id"] and f"response:{e['response_id']}"
        try:
            usage = measures(e["usage"])
        except BelowCache:
            if original:
                out.append(self._row(e, "gap", "input-below-cache", owner=thread))
            usage = {}
        else:
            if _any(e["usage"]) and not (out and placed is None and e["thread_id"] is None):
                out.append(self._usage(e, usage, thread, not original, key))
            if original:
                self.accounted = {m: self.accounted.get(m, 0) + usage.get(m, 0) for m in MEASURED}
        if compacted and original:
            self.kept = e["usage"] if self.scope == "all" else None
            self.check_dropped = self.check_dropped or (self.whose.early(e) and self.scope == "direct" and bool(usage))
        return out

    def _counter(self, e: dict, owner: str | None, unplaced: bool) -> list[dict]:
        total, last = e["total"] if _any(e["total"]) else None, e["last"] if _any(e["last"]) else None
        zero = lambda u, c: u[c] or 0
        brings = last is not None and (zero(last, "input_tokens") > 0 or zero(last, "output_tokens") > 0)
        kept = self.kept is not None and last is not None and all(zero(last, c) == zero(self.kept, c) for c in COUNTS)
        self.kept = None if brings else self.kept
        out: list[dict] = []
        if total is not None and self.check_dropped:
            self.check_dropped = False
            if any(v > self.accounted.get(m, 0) for m, v in self._read(total, {"output": 1 << 62}).items()):
                out.append(self._row(e, "gap", "boundary-unverified"))
        counts = self.scope == "all" or (self.scope == "mixed" and e["role"] == "counted")
        if not counts:
            if owner != self.file and last is not None:
                response = self.responses.get(owner)
                out.append(self._usage(e, self._read(last), owner, True, response and f"response:{response}"))
            elif owner == self.file and self.scope == "mixed" and total is not None:  # a record has counted it; later steps go on from it
                try:
                    self.meter.step(measures(total))
                except BelowCache:
                    self.meter.lose(None)
            if e["role"] == "twin":
                out.append(self._row(e, "twin", None))
            return out
        return out if total is None else out + self._step(e, total, last, owner, unplaced, kept, brings)

    def _read(self, usage: dict, otherwise: Usage | None = None) -> Usage:
        try:
            return measures(usage)
        except BelowCache:
            return otherwise or {}

    def _step(self, e: dict, total: dict, last: dict | None, owner: str | None, unplaced: bool, kept: bool, brings: bool) -> list[dict]:
        """A counter that counts: what it adds to the running total is usage, if it is this file's and can be proved."""
        out: list[dict] = []
        estimate = last is not None and not brings and (last["total_tokens"] or 0) > 0
        try:
            now: Usage | None = measures(total)
        except BelowCache:
            now = None
        if unplaced and self.whose.active == self.file and now is not None and self.meter.compared(now) != "same":
            out.append(self._row(e, "gap", "boundary-unverified"))
            owner, self.meter.base, self.meter.last = None, self.meter.last if self.meter.last is not None else self.meter.base, None
        copied = lambda: [] if last is None else [self._usage(e, self._read(last), owner, True, owner and self._key(owner, total))]
        own = owner == self.file
        if own and not estimate and not kept and last is not None:
            try:
                step: Usage | None = measures(last)
            except BelowCache:
                step = None
        else:
            step = None if last is None or estimate else self._read(last)
        if own and (now is None or (last is not None and not estimate and not kept and step is None)):
            seen = (tuple(total.values()), None if last is None else tuple(last.values()))
            if seen != self.unread and not kept:  # a refresh repeats such a step
                out.append(self._row(e, "gap", "input-below-cache", owner=owner))
            self.unread, self.total = seen, now if now is not None else self.total
            self.meter.lose(now)
            return out
        if now is None:
            self.meter.suspect = True
            return out + copied()
        self.total = now
        meter = self.meter
        if own and meter.last is None:
            # records came first: what they account for is what a total may go on from
            beside = self.scope == "mixed" and meter.base is None and any(self.accounted.values())
            meter.base = dict(self.accounted) if beside else meter.base
            if meter.suspect and not self.inherits and meter.base is not None and meter.compared(now) == "fell":
                meter.last, meter.suspect = meter.base, False  # nothing is inherited here, so a fall is a new start
            elif meter.suspect or meter.base is not None or self.whose.boundary is not None or self.whose.unmarked:
                proof = meter.proved(now, step)
                if proof == "repeated" and not (beside and brings):
                    return out
                if proof == "lowered":
                    meter.base, meter.epoch = now, meter.epoch + 1
                    return [*out, self._row(e, "diagnostic", "epoch-reset")]
                if proof in ("unverified", "repeated"):
                    code = "input-below-cache" if meter.suspect else "boundary-unverified"
                    out.append(self._row(e, "gap", code))
                    own, owner = False, None
                else:
                    meter.suspect = False
                    if proof == "unseeded":
                        meter.last, meter.epoch = {}, meter.epoch + 1
                        out.append(self._row(e, "diagnostic", "unseeded"))
                    else:
                        meter.last = meter.base or {}
        if not own:
            meter.base = now
            return out + copied()
        did, rise = meter.step(now)
        if did == "fell":
            out.append(self._row(e, "diagnostic", "epoch-reset"))
        if last is None:
            return out
        if estimate:
            filled = not total["input_tokens"] and not total["output_tokens"] and (total["total_tokens"] or 0) > 0
            return [*out, self._row(e, "diagnostic", "estimate-window" if filled else "estimate")]
        if kept or did == "same" or (did == "fell" and not brings):
            return out
        return [*out, self._usage(e, rise if did == "rose" else self._read(last), owner, False, self._key(owner, total))]

    def _key(self, owner: str, total: dict) -> str:
        return f"counter:{owner}:" + ":".join("?" if total[c] is None else str(total[c]) for c in COUNTS)

    def _row(self, e: dict, what: str, code: str | None, **more) -> dict:
        return {"locator": e["locator"], "offset": e["offset"], "what": what, "code": code, "epoch": self.meter.epoch, "turn": e["turn"] or self.turn, "ts": e["ts"], "file_thread": self.file, **more}

    def _usage(self, e: dict, usage: Usage, owner: str | None, copy: bool, key: str | None) -> dict:
        return self._row(e, "usage", None, owner=owner, copy=copy, key=key, **usage)


_OUT = {
    "locator": pa.string(), "offset": pa.int64(), "file_thread": pa.string(), "what": pa.string(), "code": pa.string(), "owner": pa.string(), "copy": pa.bool_(), "key": pa.string(), "epoch": pa.int32(), "turn": pa.string(), "ts": pa.timestamp("us"),
    **dict.fromkeys(MEASURED, pa.int64()),
}
_SCHEMA = "locator string, offset long, file_thread string, what string, code string, owner string, copy boolean, key string, epoch int, turn string, ts timestamp_ntz, " + ", ".join(f"{m} long" for m in MEASURED)


def observe(rows: DataFrame) -> DataFrame:
    """Usage, twins, gaps and diagnostics of typed rows. Gaps: `boundary-unverified` and `input-below-cache`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = at = None
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if state is None or e["locator"] != at:
                    out += state.end() if state else []
                    state, at = Pass(e, e["seeded"]), e["locator"]
                out += state.step(e)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], k) for c, k in _OUT.items()], names=list(_OUT))
        if state and (out := state.end()):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], k) for c, k in _OUT.items()], names=list(_OUT))

    # an unmarked fork whose first counter goes on from a total of before its first line copied nothing
    both = _is(_COUNTER) & _reported("total") & _reported("last")
    first = F.first(F.when(both, F.struct(signature("total", "0").alias("total"), signature("last", "0").alias("last"), F.coalesce("recorded", F.lit(False)).alias("recorded"))), True)
    whole = first.over(_file(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = with_evidence(with_roles(rows)).withColumn("_first", whole).withColumn("seeded", F.coalesce((F.col("_first.total") != F.col("_first.last")) & ~F.col("_first.recorded"), F.lit(False)))
    needed = ("locator", "offset", "kind", "file_thread", "file", "seeded", "role", "lone", "recorded", "ts", "ordinal", "id", "boundary_invalid", "thread_id", "response_id", "turn", "usage", "total", "last")
    return marked.select(*needed).repartition("locator").sortWithinPartitions("locator", "offset").mapInArrow(run, _SCHEMA)
