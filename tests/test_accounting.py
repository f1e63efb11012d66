"""Which usage of a rollout counts and whose it is: small files made here, each a case, against totals worked out by hand."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_dialects import count, record, used, write
from tokenloom.sources import accounting, logs, rollouts

ONE, TWO, BOTH, GUESS = used(1000, 0, 100), used(3000, 0, 300), used(4000, 0, 400), used(0, 0, 0, 3200)
CONTEXT = {"type": "turn_context", "payload": {"turn_id": "t2"}}
LIMITS = {"type": "event_msg", "payload": {"type": "token_count", "info": None, "rate_limits": {"limit_id": "x", "primary": {"used_percent": 1}}}}


def name(i):
    return f"{i:036}"


def meta(i, **more):
    return {"type": "session_meta", "payload": {"id": name(i), **more}}


def turn(t, ordinal=None):
    return {"type": "turn_context", "ordinal": ordinal, "payload": {"turn_id": t, "model": "m"}}


def reasoned(i, o, r, total=None):
    return {**used(i, 0, o, total), "reasoning_output_tokens": r}


#: (lines after the file's own header, scope, roles of the counters)
ROLES = [
    ([count(ONE, ONE), count(TWO, used(2000, 0, 200))], "all", ["counted", "counted"]),
    ([record(None, "r1", ONE), count(ONE, ONE)], "direct", ["twin"]),
    ([count(ONE, ONE), record(None, "r1", ONE)], "direct", ["twin"]),
    ([count(ONE, ONE), record(None, "r1", ONE), count(used(2000, 0, 200), ONE)], "mixed", ["twin", "counted"]),
    ([count(ONE, ONE), CONTEXT, record(None, "r1", ONE), count(used(2000, 0, 200), ONE)], "mixed", ["counted", "twin"]),
    ([count(ONE, ONE), record(None, "r1", ONE), count(used(2000, 0, 200), ONE), record(None, "r2", ONE)], "direct", ["twin", "twin"]),
    ([record(None, "r1", reasoned(1000, 100, 10)), count(reasoned(1000, 100, 11), reasoned(1000, 100, 11))], "mixed", ["counted"]),
    ([record(None, "r1", ONE), count(ONE, used(1000, 0, 100, 1101))], "mixed", ["counted"]),
    ([record(None, "r1", ONE), count(ONE, ONE), count(ONE, ONE), LIMITS], "direct", ["twin", "covered", "covered"]),
    ([count(ONE, ONE), count(ONE, GUESS), record(None, "r1", TWO), count(BOTH, TWO), count(BOTH, GUESS)], "mixed", ["counted", "counted", "twin", "covered"]),
    ([LIMITS, record(None, "r1", ONE), count(ONE, ONE)], "direct", ["covered", "twin"]),
    ([record(None, "r1", ONE), record(None, "r2", ONE), count(ONE, ONE), count(used(2000, 0, 200), ONE)], "mixed", ["twin", "counted"]),
]


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    """Files' lines to typed rows; all in one run."""

    def run(files):
        root = tmp_path_factory.mktemp("rollouts")
        for i, rows in files.items():
            write(root, f"sessions/rollout-2026-09-16T05-00-00-{name(i)}.jsonl", rows)
        lines = logs.read_lines(spark, str(root))
        return lines, rollouts.events(lines).cache()

    return run


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(int(r["file_thread"]), []).append(r)
    return out


def test_roles_of_counters(read):
    lines, rows = read({i: [meta(i), *case] for i, (case, *_) in enumerate(ROLES)} | {90: [meta(90, forked_from_id=name(91)), count(TWO, TWO), record(None, "r", ONE), count(ONE, ONE)]})
    got = by_file(accounting.with_roles(rows).filter("kind = 'token_count'").orderBy("file_thread", "offset").select("file_thread", "file.scope", "role").collect())
    for i, (_, scope, roles) in enumerate(ROLES):
        # an estimate after a twin or record is covered, after a counted counter counted
        assert ({r["scope"] for r in got[i]}, [r["role"] for r in got[i]][: len(roles)]) == ({scope}, roles), i
    assert {r["scope"] for r in got[90]} == {"direct"}


def sums(rows):
    """Of the file's own originals: input and output; then copies, gaps and diagnostics by code."""
    own = [r for r in rows if r["what"] == "usage" and not r["copy"]]
    codes = Counter(r["code"] for r in rows if r["what"] in ("gap", "diagnostic"))
    return sum((r["uncached_input"] or 0) for r in own), sum(r["output"] or 0 for r in own), sum(r["what"] == "usage" and bool(r["copy"]) for r in rows), dict(codes)


PARENT = [meta(50), turn("p1"), count(used(100, 0, 10), used(100, 0, 10)), turn("p2"), count(used(150, 0, 15), used(50, 0, 5))]


def child(i, *lines, start=None, **more):
    return [{"type": "session_meta", "ordinal": 0, "payload": {"id": name(i), "parent_thread_id": name(50), **({"subagent_history_start_ordinal": start} if start is not None else {}), **more}}, *lines]


CASES = {
    # both orders of a twin, and none
    1: ([meta(1), count(used(10, 0, 1), used(10, 0, 1)), record(name(1), "r1", used(10, 0, 1))], (10, 1, 0, {})),
    2: ([meta(2), record(name(2), "r1", used(10, 0, 1)), record(name(2), "r2", used(20, 0, 2)), count(used(30, 0, 3), used(7, 0, 7))], (30, 3, 1, {"boundary-unverified": 1})),
    # records and twins move the total that a counter of an earlier release goes on from
    3: ([meta(3), record(name(3), "r1", used(10, 0, 1)), count(used(10, 0, 1), used(10, 0, 1)), CONTEXT, count(used(35, 0, 4), used(25, 0, 3))], (35, 4, 0, {})),
    # a file that may hold another's history counts no counter beside records
    4: ([meta(4, forked_from_id=name(50)), count(used(500, 0, 50), used(50, 0, 5)), record(name(4), "r1", used(20, 0, 2)), count(used(520, 0, 52), used(20, 0, 2))], (20, 2, 0, {})),
    # first steps after an inherited total: goes on from it, repeats it, starts alone, falls without usage, can't be proved
    10: (child(10, count(used(100, 0, 10), used(100, 0, 10), 1), count(used(130, 0, 13), used(30, 0, 3), 6), start=5), (30, 3, 1, {})),
    11: (child(11, count(used(100, 0, 10), used(100, 0, 10), 1), count(used(100, 0, 10), used(100, 0, 10), 6), count(used(104, 0, 11), used(4, 0, 1), 7), start=5), (4, 1, 1, {})),
    12: (child(12, count(used(100, 0, 10), used(100, 0, 10), 1), count(used(130, 0, 13), used(130, 0, 13), 6), start=5), (130, 13, 1, {"unseeded": 1})),
    13: (child(13, count(used(100, 0, 10), used(100, 0, 10), 1), count(used(60, 0, 6), used(0, 0, 0), 6), count(used(65, 0, 7), used(5, 0, 1), 7), start=5), (5, 1, 1, {"epoch-reset": 1})),
    14: (child(14, count(used(100, 0, 10), used(100, 0, 10), 1), count(used(190, 0, 19), used(30, 0, 3), 6), count(used(200, 0, 20), used(10, 0, 1), 7), start=5), (10, 1, 2, {"boundary-unverified": 1})),
    # a boundary that is no ordinal, and lines without one, place nothing
    15: (child(15, count(used(10, 0, 1), used(10, 0, 1), 6), start="soon"), (0, 0, 1, {"boundary-invalid": 1, "boundary-unverified": 1})),
    16: (child(16, count(used(10, 0, 1), used(10, 0, 1)), start=5), (0, 0, 1, {"boundary-unverified": 1})),
    # a boundary that no line reaches: the parent's turns say where the file's own lines start
    20: (child(20, turn("p1", 1), count(used(100, 0, 10), used(100, 0, 10), 2), turn("c1", 3), count(used(140, 0, 14), used(40, 0, 4), 4), start=9), (40, 4, 1, {})),
    21: (child(21, turn(None, 1), count(used(40, 0, 4), used(40, 0, 4), 2), start=9), (0, 0, 1, {"boundary-unverified": 1})),
    # a turn of the parent after what was taken for the file's own refutes it
    22: (child(22, turn("c1", 1), count(used(40, 0, 4), used(40, 0, 4), 2), turn("p2", 3), count(used(70, 0, 7), used(30, 0, 3), 4), start=9), (0, 0, 1, {"boundary-unverified": 2})),
    # so does a total of the parent
    23: (child(23, turn("c1", 1), count(used(40, 0, 4), used(40, 0, 4), 2), count(used(150, 0, 15), used(50, 0, 5), 3), start=9), (0, 0, 1, {"boundary-unverified": 1})),
    # an unmarked fork: counters only, paginated, its first counter a copy of the parent's
    24: ([{"type": "session_meta", "payload": {"id": name(24), "forked_from_id": name(50), "history_mode": "paginated"}}, turn("p1"), count(used(100, 0, 10), used(100, 0, 10)), turn("c1"), count(used(109, 0, 11), used(9, 0, 1))], (9, 1, 1, {})),
    # a header of the parent's and a turn that it never had
    25: ([meta(25, parent_thread_id=name(50)), meta(50), turn("p1"), count(used(100, 0, 10), used(100, 0, 10)), turn("c1"), count(used(120, 0, 12), used(20, 0, 2))], (20, 2, 1, {})),
    # a compacted line that alone keeps its response is an original, and its counter adds nothing
    26: ([meta(26), {"type": "compacted", "payload": {"latest_token_usage_record": {"thread_id": name(26), "response_id": "z", "usage": used(6, 0, 2)}}}, count(used(6, 0, 2), used(6, 0, 2)), count(used(9, 0, 3), used(3, 0, 1))], (9, 3, 0, {})),
    # what can't be read ends the run: later steps are proved against it
    27: ([meta(27), count(used(10, 0, 1), used(10, 0, 1)), count(used(20, 0, 2), used(5, 9, 1)), count(used(26, 0, 3), used(6, 0, 1))], (16, 2, 0, {"input-below-cache": 1})),
}


def test_usage_of_files(read):
    lines, rows = read({50: PARENT} | {i: c for i, (c, _) in CASES.items()})
    found = by_file(accounting.observe(rows).orderBy("file_thread", "offset").collect())
    got = {i: sums(found.get(i, [])) for i in CASES}
    assert got == {i: want for i, (_, want) in CASES.items()}
    assert sums(found[50]) == (150, 15, 0, {})
    owners = {r["owner"] for r in found[20] if r["what"] == "usage" and r["copy"]}
    assert owners == {name(50)}


def test_lines_of_copied_history(read):
    noise = {"type": "response_item", "payload": {"x": 1}}
    file = [meta(25, parent_thread_id=name(50)), noise, meta(50), noise, noise, turn("p1"), noise, count(used(100, 0, 10), used(100, 0, 10)), noise, turn("c1"), noise, count(used(120, 0, 12), used(20, 0, 2))]
    lines, rows = read({50: PARENT, 25: file})
    marked = accounting.with_evidence(accounting.with_roles(rows))
    assert [tuple(r)[1:] for r in accounting.copied_lines(lines, marked).collect()] == [(7,)]
