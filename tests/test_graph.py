"""Components of graphs with giant stars, against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import graph, joins, reconcile


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def made(seed):
    rng = random.Random(seed)
    small, large = [(0, 2 * i + 10) for i in range(400)], [(5001, 2 * i + 11) for i in range(400)]  # hubs below and above their leaves
    chain = [(6000 + i, 6001 + i) for i in range(60)]
    loose = [(rng.randint(7000, 7400), rng.randint(7000, 7400)) for _ in range(250)]
    return small + large + chain + loose + [(9000, 9000), (0, 0)] + [(p[1], p[0]) for p in small[:50]] + ([(10, 6030), (5001, 7000)] if seed % 2 else [])


@pytest.mark.parametrize("seed, hot", [(1, 20), (2, 20), (1, 10_000)])
def test_components_with_hubs(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(joins, "HOT", hot)
    pairs = made(seed)
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union_find(pairs)


def test_a_hub_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 1000)
    leaves = spark.range(1, 40_001, 1, 8).select(F.lit(0).cast("long").alias("n"), F.col("id").alias("m"))
    hub = spark.createDataFrame([(0, 0)], "n long, least long")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = joins.dealt_join(leaves, hub, ["n"], F.xxhash64("m"))
        sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert sum(sizes) == 40_000 and len(sizes) == 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_together_store_a_few_times_the_links(spark, monkeypatch):
    rows = []
    for name in ("stored", "written"):
        keep = getattr(graph, name, None)
        monkeypatch.setattr(graph, name, lambda df, keep=keep: (out := keep(df), rows.append(out.count()))[0], raising=False)
    names = random.Random(5).sample(range(10**6), 4000)
    chain = [(f"n{a}", f"n{b}") for a, b in zip(names, names[1:], strict=False)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == dict.fromkeys(got, min(got)) and len(got) == 4000
    assert sum(rows) < 8 * 4000  # links and nodes of all rounds, and the two lists of names


def test_numbers_that_clash_are_drawn_anew(spark, monkeypatch):
    right, salts = graph.hashed, []
    monkeypatch.setattr(graph, "hashed", lambda node, salt: (salts.append(salt), F.pmod(right(node, 0), F.lit(50)) if salt < 2 else right(node, salt))[1])
    pairs = [(f"a{i}", f"a{i // 2}") for i in range(100)] + [(f"b{i}", f"b{i // 3}") for i in range(100)] + [("c", "c")]
    edges = spark.createDataFrame([*pairs, (None, "a1"), ("d", None), (None, None)], "a string, b string")
    got = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert got == union_find(pairs) and set(salts) == {0, 1, 2}


@pytest.mark.parametrize("hot", [20, 10_000])
def test_sets_by_keys_that_few_or_many_share(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT", hot)
    rows = [(i, [f"x{i % 3}", None, f"y{i}"]) for i in range(300)] + [(i, [f"z{i}", f"z{i + 1}", f"z{i}"]) for i in range(300, 400)]
    rows += [(400, ["y7", "z300"]), (401, []), (402, [None]), (403, None), (404, ["alone"]), (404, ["alone"]), (405, ["alone"])]
    keyed = [(i, [k for k in keys or [] if k] or [f"local:{i}"]) for i, keys in rows]
    root = union_find([(keys[0], k) for _, keys in keyed for k in keys])
    got = reconcile.linked_sets(spark.createDataFrame(rows, "id int, keys array<string>"), "id", "keys")
    assert got.columns == ["id", "set_id"]
    assert sorted(map(tuple, got.collect())) == sorted((i, root[keys[0]]) for i, keys in keyed)
