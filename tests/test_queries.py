"""Registered queries against their SQL, and the rules that SQL over the tables can't show."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import identity, measures
from tokenloom.operators import graph, ordered, reconcile, rollups, selection
from tokenloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages conversations".split()


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _plain(got.collect(), got.columns) == _plain(want.fetchall(), columns)


def test_golden_id(spark):
    got = spark.range(1).select(identity.analytical_id("req", "provider-response", F.lit("anthropic"), F.lit("msg_01"))).first()[0]
    assert got == "req-v1-74jwmxh9ngbvdmk5zgvcrtgszc"


def test_unknown_is_not_zero(spark):
    rows = spark.sql("SELECT CAST(NULL AS BIGINT) a, CAST(NULL AS BIGINT) b UNION ALL SELECT 1, NULL UNION ALL SELECT 0, 2")
    got = [r[0] for r in rows.select(measures.sum_known(F.col("a"), F.col("b"))).collect()]
    assert got == [None, 1, 2]


@pytest.mark.parametrize(("text", "want"), [("5", 5), ("5.0", 5), ("5.5", None), ("-1", None), ("x", None), (None, None)])
def test_whole_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(measures.whole_number(F.col("v"))).first()[0] == want


def test_running_totals():
    rows = pd.DataFrame({"i": [10, 10, 25, None, 8], "o": [1, 1, 4, 6, 6]})
    out = ordered.running_totals(rows, ["i", "o"])
    assert out["event"].tolist() == ["advanced", "repeated", "advanced", "advanced", "reset"]
    assert out["epoch"].tolist() == [0, 0, 0, 0, 1]
    assert [tuple(None if pd.isna(x) else int(x) for x in r) for r in out[["delta_i", "delta_o"]].itertuples(index=False)] == [(10, 1), (None, None), (15, 3), (None, 2), (8, 6)]


def test_grouped_counters_carry_over_batches(spark):
    big = 2**53 + 1
    rows = [(s, i, None if i % 3 == 2 else (i % 40) * (1 + (s or 0)), big + i if i % 2 else None) for s in (1, 2, None) for i in range(100)]
    docs = spark.createDataFrame(rows, "s int, i int, a long, b long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = ordered.grouped_counter_deltas(docs, "s", ["i"], ["a", "b"])
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        got = {(r["s"], r["i"]): tuple(r)[4:] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for s in (1, 2, None):
        counters = ordered.Counters(["a", "b"])
        want |= {(s, r[1]): tuple(counters.step(r[2:])) for r in rows if r[0] == s}
    assert got == want and {e for *_, e, _ in want.values()} >= {"advanced", "repeated", "reset"}


def test_linked_sets_of_all_events(spark, duck):
    events = duck.execute("SELECT event_id, user_id, date_trunc('hour', ts), props->>'$.k' FROM events").fetchall()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for event, user, hour, k in events:
        for key in (("h", user, hour), ("k", user, k)):
            if None not in key:
                parent[find(key)] = find(("e", event))
    want, got = {}, {}
    for event, *_ in events:
        want.setdefault(find(("e", event)), set()).add(event)
    for r in registry.queries()["linked_sets_events"](spark, SF).collect():
        got.setdefault(r["set_id"], set()).add(r["observation"])
    assert len(events) > 400 and sum(map(len, got.values())) == len(events)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_linked_sets_of_all_customers(spark, duck):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    customers = [c for (c,) in duck.execute("SELECT c_custkey FROM customer").fetchall()]
    for c in customers:
        for key in (("a", c // 7), ("b", c % 97)) if c % 50 else ():
            parent[find(key)] = find(("c", c))
    want, got = {}, {}
    for c in customers:
        want.setdefault(find(("c", c)), set()).add(c)
    for r in registry.queries()["linked_sets"](spark, SF).collect():
        got.setdefault(r["set_id"], set()).add(r["observation"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) >= 3


def test_latest_revision_goes_by_place_unless_all_have_a_sequence(spark):
    rows = spark.createDataFrame([("a", 1, 5, 10), ("a", 2, None, 20), ("b", 1, 7, 30), ("b", 2, 6, 40)], "s string, off int, seq int, output int")
    marked = reconcile.complete_sequences(rows, ["s"], "seq")
    got = {r["s"]: r["output"] for r in reconcile.select_revision(marked, ["s"], reconcile.latest_revision("seq", ["off"]), ["output"], ["output"]).collect()}
    assert got == {"a": 20, "b": 30}


def test_repeated_candidates_and_unknown_values(spark):
    rows = spark.createDataFrame([([1, 1],), ([1, 2],), ([3],), ([],)], "c array<int>")
    assert [r[0] for r in rows.select(rollups.placement("c", F.array(F.lit(1)))).collect()] == ["inside", "possible", "outside", "outside"]


def test_runs_keep_the_order_of_all_columns(spark):
    rows = spark.createDataFrame([("s", 1, 9, "x"), ("s", 2, 3, "x"), ("s", 3, 1, "y")], "t string, a int, b int, v string")
    got = sorted((r["v"], r["first"], r["last"]) for r in ordered.runs(rows, ["t"], ["a", "b"], "v").collect())
    assert got == [("x", 9, 3), ("y", 1, 1)]


def test_collisions_are_refused(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "id string, bits string")
    assert reconcile.refuse_collisions(rows, "id", "bits").count() == 3
    with pytest.raises(ValueError):
        reconcile.refuse_collisions(rows.union(rows.select(F.lit("a"), F.lit("3"))), "id", "bits")


def test_components_and_descendants_stand_cycles(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    edges = spark.createDataFrame(chain, "a int, b int")
    got = dict((r["node"], r["root"]) for r in graph.connected_components(edges).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[200] == 200
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    assert {(r["node"], r["depth"]) for r in graph.descendants(loop, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_descendants_of_a_chain_of_over_100_nodes(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(103)], "parent int, child int")
    got = graph.descendants(chain, spark.createDataFrame([(0,)], "node int")).collect()
    assert sorted((r["node"], r["depth"]) for r in got) == [(i, i) for i in range(104)]


def test_selectors(spark):
    threads = spark.createDataFrame([("t1", "n1", "p1"), ("t2", "n2", "p2"), ("t3", "n2", "p3")], "id string, native_id string, path string")
    assert selection.resolve(threads, "p1") == "t1" and selection.resolve(threads, "n1") == "t1"
    with pytest.raises(selection.UnknownSelector):
        selection.resolve(threads, "n9")
    with pytest.raises(selection.AmbiguousSelector):
        selection.resolve(threads, "n2")
    with pytest.raises(ValueError):
        selection.select([])


def test_sums_agree_between_views(spark):
    from tokenloom.plans.tables import observations

    obs = observations(spark, SF)
    days = rollups.daily(obs, "seen_ts").agg(F.sum("total")).first()[0]
    threads = obs.select("thread").distinct()
    sessions = rollups.sessions(threads, obs.withColumnRenamed("thread", "owner"), "thread", "owner", "seen_ts").agg(F.sum("total")).first()[0]
    assert days == sessions == obs.select(measures.total().alias("t")).agg(F.sum("t")).first()[0]


def test_order_of_input_does_not_matter(spark):
    from tokenloom.plans.tables import observations

    rows = observations(spark, SF).select("off", "thread", "output", "k")
    order = reconcile.largest_output("output", "k", ["off"])
    once = reconcile.select_revision(rows, ["thread"], order, ["off"], ["k"])
    again = reconcile.select_revision(rows.orderBy(F.rand(3)).repartition(7), ["thread"], order, ["off"], ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_rates_beyond_a_broadcast_are_the_same(spark):
    from tokenloom.operators import prices
    from tokenloom.plans.tables import observations

    rows = observations(spark, SF).withColumn("size", measures.inclusive_input()).select("off", "model", "ts", "size")
    once, again = (prices.with_rate(rows, prices.rates(spark), "off", "ts", "size", most).select("off", "rate") for most in (prices.MOST, 0))
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString().split("LocalRelation")[0].split("Join")[0]
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_percentiles_and_medians_of_few_values(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 9), ("b", 7), (None, 3), (None, 5), ("c", None)], "g string, v long")
    assert {r["g"]: r["m"] for r in rollups.medians(rows, ["g"], F.col("v"), "m").collect()} == {"a": 3.0, "b": 7.0, None: 4.0}
    got = {r["g"]: (r["count"], r["p50"], r["p90"], r["max"]) for r in rollups.sizes(rows, ["g"], F.col("v")).collect()}
    assert got == {"a": (4, 2, 9, 9), "b": (1, 7, 7, 7), None: (2, 3, 5, 5)}


def test_hooks(spark):
    threads = spark.createDataFrame([("t1", "s1", "/p/s1.jsonl", "s1", None), ("t2", "s1/a1", "/p/s1/subagents/agent-a1.jsonl", "s1", "a1"), ("t3", "r1", "/r.jsonl", None, None)], "id string, native_id string, path string, session string, child string")
    main = selection.hook_input('{"session_id": "s1", "transcript_path": "/p/s1.jsonl"}')
    stop = selection.hook_input('{"session_id": "s1", "agent_id": "a1", "hook_event_name": "SubagentStop", "transcript_path": "/p/s1.jsonl", "agent_transcript_path": "/p/s1/subagents/agent-a1.jsonl"}')
    assert (selection.resolve_hook(threads, main), selection.resolve_hook(threads, stop)) == ("t1", "t2")
    assert selection.resolve_hook(threads, {"session": "r1", "child": None, "path": "/r.jsonl"}, one_id=True) == "t3"
    for wrong in (main | {"session": "s9"}, main | {"child": "a1"}, stop | {"child": "a2"}):
        with pytest.raises(selection.HookMismatch):
            selection.resolve_hook(threads, wrong)
    with pytest.raises(selection.UnsavedSession):
        selection.resolve_hook(threads, selection.hook_input('{"session_id": "s1", "transcript_path": null}'))
    for text in ("{", "[]", '{"session_id": 1, "transcript_path": "x"}', '{"session_id": "s1"}', '{"session_id": "s1", "transcript_path": 3}'):
        with pytest.raises(ValueError):
            selection.hook_input(text)


def test_fnv_of_texts(spark):
    known = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}

    def plainly(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    texts = [*known, "é😀", "x" * 300, None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(identity.fnv64(F.col("t"))).collect()]
    assert got == [*known.values(), plainly("é😀"), plainly("x" * 300), None]


def test_counts_that_stop_or_fail(spark):
    most = measures.MOST
    rows = spark.createDataFrame([("a", most), ("a", most), ("b", 7), ("b", None), ("c", None)], "g string, n long")
    got = {r["g"]: r["s"] for r in rows.groupBy("g").agg(measures.saturating_sum(F.col("n")).alias("s")).collect()}
    assert got == {"a": most, "b": 7, "c": None}
    with pytest.raises(Exception, match="(?i)overflow"):
        rows.groupBy("g").agg(F.sum("n")).collect()
    assert [r[0] for r in spark.range(0, 8).select(measures.ceil_div(F.col("id"), 3)).collect()] == [0, 1, 1, 1, 2, 2, 2, 3]
    assert spark.range(1).select(measures.ceil_div(F.lit(most), 100)).first()[0] == -(-most // 100)
