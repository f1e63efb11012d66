"""Conditions on rows, calendar periods in zones whose clocks jump, choices of threads."""

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tests.test_ledger import read, root  # noqa: F401  (fixtures)
from tokenloom import ledger
from tokenloom.operators import conditions, selection


@pytest.mark.parametrize("zone, day", [
    ("America/Sao_Paulo", date(2018, 11, 4)), ("America/Sao_Paulo", date(2018, 2, 18)), ("Pacific/Apia", date(2011, 12, 31)), ("Europe/Berlin", date(2024, 3, 31)), ("America/New_York", date(2024, 11, 3)),
    ("America/Toronto", date(1919, 3, 31)), ("Asia/Kolkata", date(2024, 1, 1)), ("America/Havana", date(2024, 11, 3)), ("Asia/Beirut", date(2024, 3, 31)),
])
def test_midnight_is_the_first_instant_of_a_date(zone, day):
    at = datetime(day.year, day.month, day.day, tzinfo=UTC) - timedelta(days=1, hours=6)
    while at.astimezone(ZoneInfo(zone)).date() < day:
        at += timedelta(minutes=1)
    assert conditions.midnight(day, zone) == at


def test_last_periods():
    now = datetime(2024, 3, 31, 12, tzinfo=UTC)
    day = lambda *d: datetime(*d, tzinfo=UTC)
    assert conditions.last_periods(1, "day", now) == (day(2024, 3, 31), day(2024, 4, 1))
    assert conditions.last_periods(2, "week", now) == (day(2024, 3, 18), day(2024, 4, 1))
    assert conditions.last_periods(2, "week", now, week_start="sunday") == (day(2024, 3, 24), day(2024, 4, 7))
    assert conditions.last_periods(14, "month", now) == (day(2023, 2, 1), day(2024, 4, 1))
    berlin = conditions.last_periods(1, "day", now, "Europe/Berlin")
    assert berlin == (day(2024, 3, 30, 23), day(2024, 3, 31, 22))  # 23 hours
    assert conditions.last_periods(1, "day", day(2024, 3, 31, 23), "Europe/Berlin")[0] == day(2024, 3, 31, 22)
    for bad in ((0, "day"), (1, "year")):
        with pytest.raises(ValueError):
            conditions.last_periods(*bad, now)


def test_only_what_is_true_selects(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 5, 'a.c', TIMESTAMP_NTZ '2024-01-01'), (2, NULL, 'abc', TIMESTAMP_NTZ '2024-01-02'), (3, 1, NULL, NULL) t(id, x, s, ts)")
    ids = lambda c: [r["id"] for r in rows.filter(c).orderBy("id").collect()]
    x = F.col("x")
    assert (ids(x > 3), ids(~(x > 3)), ids(conditions.is_missing(x)), ids(conditions.is_present(x)), ids((x > 3) | conditions.is_missing(x))) == ([1], [3], [2], [1, 3], [1, 2])
    assert ids(conditions.has_text(F.col("s"), "a.c")) == [1] and ids(~conditions.has_text(F.col("s"), "a.c")) == [2]
    at = lambda d: datetime(2024, 1, d, tzinfo=UTC)
    ts = F.col("ts")
    assert ids(conditions.during(ts)) == [1, 2, 3]
    assert (ids(conditions.during(ts, at(1), at(2))), ids(conditions.during(ts, at(2))), ids(conditions.during(ts, until=at(2)))) == ([1], [2], [1])
    assert ids(conditions.during(ts, at(2).astimezone(ZoneInfo("Asia/Tokyo")))) == [2]
    assert [str(r[0]) for r in rows.orderBy("id").select(conditions.period_of(ts, "week", "America/New_York")).collect()] == ["2023-12-25", "2024-01-01", "None"]


def test_choices_of_a_ledger(read):  # noqa: F811
    total = lambda led, chosen=None: ledger.report(led, chosen).first()["output"]
    every = total(read)
    dated = ledger.within(read, datetime(2000, 1, 1, tzinfo=UTC))
    days = {r["date"]: r["output"] for r in ledger.daily(read).collect()}
    assert total(dated) == sum(v for d, v in days.items() if d is not None)
    assert total(ledger.within(read, where=F.col("model") == "m2")) == 2 and total(ledger.within(read, until=datetime(2000, 1, 1, tzinfo=UTC))) is None
    last = [r["id"] for r in ledger.latest(read).collect()]
    assert len(last) == 1 and total(read, ledger.latest(read)) <= every
    chosen = ledger.active(read, datetime(2000, 1, 1, tzinfo=UTC))
    assert last[0] in {r["id"] for r in chosen.collect()}
    groups = {r["value"]: r["output"] for r in ledger.by(read, F.col("model"), having=F.col("output") > 5).collect()}
    assert groups == {"m1": 20, "m9": 10}
    named = ledger.of_projects(read, ["proj"])
    assert total(read, named) == 22 + 10  # all transcripts and the first rollout name it


def test_thread_sources(spark):
    evidence = spark.createDataFrame([("t1", "s1"), ("t1", "s1"), ("t2", "s2"), ("t3", "none")], "thread string, source string")
    located = spark.createDataFrame([("t3", "n3"), ("t1", "n1"), ("t4", "n4")], "thread string, native_id string")
    sources = spark.createDataFrame([("s1", "x", ["a", "a.gz"]), ("s2", "n1/y", ["b"]), ("s3", "n3/deep/z", ["c"]), ("s4", "n4", ["d"]), ("s5", None, ["e"])], "source string, locator string, paths array<string>")
    got = sorted(tuple(r) for r in selection.thread_sources(evidence, located, sources).collect())
    assert got == [("t1", "a"), ("t1", "a.gz"), ("t1", "b"), ("t2", "b"), ("t3", "c")]


def test_defaults_of_commands(read):  # noqa: F811
    names = {"claude": "ONE", "codex": "TWO"}
    ids = lambda chosen: None if chosen is None else {r["id"] for r in chosen.collect()}
    assert ledger.choice(read, "daily") is None and ledger.choice(read, "sessions") is None and ledger.choice(read, "report", given=True) is None
    with pytest.raises(selection.UnknownSelector):
        ledger.choice(read, "report")
    with pytest.raises(ValueError):
        ledger.choice(read, "weekly")
    own = ids(ledger.choice(read, "report", environment={"ONE": "one"}, variables=names))
    assert own == ids(ledger.choice(read, "daily", ["one"])) == ids(ledger.choice(read, "daily", current=True, environment={"ONE": "one"}, variables=names)) and "one" in own and len(own) > 1
    assert ids(ledger.choice(read, "report", ["one"], scope="self")) == {"one"}
    assert ids(ledger.choice(read, "report", ["two"], current=True, environment={"ONE": "three"}, variables=names)) == set()
    assert ids(ledger.choice(read, "report", ["three"], everything=True)) == {"three"}
