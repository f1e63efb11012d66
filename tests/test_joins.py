"""Interval joins, dealt joins, mergeable states and bundles against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import histograms, joins
from tokenloom.sinks import bundles


def spans(n, seed, most):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        begin = rng.randint(-50, 1000)
        out.append((rng.choice("xy"), i, begin, begin + rng.choice((0, 1, 1, 2, 7, 60, most, -3))))
    return out


@pytest.mark.parametrize("hot", [10_000, 5])
def test_overlaps_against_all_pairs(spark, hot, monkeypatch):
    monkeypatch.setattr(joins, "HOT", hot)
    a, b = spans(120, 1, 900), spans(90, 2, 400)
    left = spark.createDataFrame([*a, (None, 999, 0, 10), ("x", 998, None, 5)], "key string, i long, s long, e long")
    right = spark.createDataFrame([*b, (None, 997, 0, 10)], "key string, j long, f long, t long")
    for cell in (1, 16, 4096):
        got = sorted((r["i"], r["j"]) for r in joins.overlap_join(left, right, ["key"], ("s", "f"), ("e", "t"), cell).collect())
        assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
    assert joins.overlap_join(left.limit(0), right, ["key"], ("s", "f"), ("e", "t"), 16).count() == 0


def test_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 100)
    large = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(7, "seven"), (7, "again"), (4, "four"), (None, "none")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = joins.dealt_join(large, small, ["k"], F.col("id"), how)
        assert got.count() == large.join(small, "k", how).count() and "_salt" in got._jdf.queryExecution().toString()


def test_windows_are_recorded_not_inferred(spark):
    limits = spark.createDataFrame([("a", 3600, 30), ("a", None, 30), ("a", 9000, None), ("b", 3600, 60)], "who string, resets_at long, window_minutes long")
    requests = spark.createDataFrame([("a", 1799), ("a", 1800), ("a", 3599), ("a", 3600), ("b", 0)], "who string, at long")
    got = joins.in_windows(requests, joins.recorded_windows(limits), ["who"], "at").select("who", "at", "starts").collect()
    assert sorted(map(tuple, got)) == [("a", 1800, 1800), ("a", 3599, 1800), ("b", 0, 0)]


def test_states_of_any_split_merge_to_that_of_all(spark):
    rng = random.Random(3)
    rows = [(rng.choice("pq"), i, rng.choice((0, -4, None, rng.randint(1, 9), rng.randint(1, 10**9)))) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    once = {r["g"]: r for r in histograms.histogram_state(df, ["g"], "v", "i").collect()}
    shards = histograms.histogram_state(df.withColumn("s", F.col("i") % 7), ["g", "s"], "v", "i")
    half = histograms.merge_states(shards.withColumn("h", F.col("s") % 2), ["g", "h"])
    again = {r["g"]: r for r in histograms.merge_states(half, ["g"]).collect()}
    assert again == once
    every = histograms.merge_states(shards, [])
    assert every.first()["count"] == sum(v is not None for *_, v in rows)
    for p in (1, 50, 90, 99, 100):
        for r in histograms.merge_states(half, ["g"]).select("g", histograms.quantile_bounds(F.struct("*"), p).alias("q")).collect():
            own = sorted(v for g, _, v in rows if g == r["g"] and v is not None)
            exact = own[-(-len(own) * p // 100) - 1]
            assert r["q"]["low"] <= exact <= r["q"]["high"] and (exact <= 0 or r["q"]["high"] <= 1.25 * r["q"]["low"] + 1)
    for g, r in once.items():
        assert [tuple(t) for t in r["top"]] == sorted(((v, i) for k, i, v in rows if k == g and v is not None), reverse=True)[: histograms.TOP]


def test_bundles_merge_to_their_union(spark, tmp_path):
    rows = [(f"log{i % 3}", i * 10, i) for i in range(60)]
    observed = spark.createDataFrame(rows, "locator string, offset long, output long")
    extents = spark.createDataFrame([(f"log{i % 3}", i * 10, i * 10 + 10) for i in range(60)], "locator string, begin long, end long")
    parts = {"early": "offset < 300", "late": "offset >= 200", "one": "locator = 'log1'"}
    for name, where in parts.items():
        bundles.write_bundle(observed.filter(where), extents.filter(where.replace("offset", "begin")), f"{tmp_path}/{name}")
    store = f"{tmp_path}/store"
    assert bundles.import_bundle(spark, store, f"{tmp_path}/early") == {"observations": 30, "disjoint": 3}
    assert bundles.import_bundle(spark, store, f"{tmp_path}/early") == {"observations": 0, "covered": 3}
    assert bundles.import_bundle(spark, store, f"{tmp_path}/late") == {"observations": 30, "partial": 3}
    assert bundles.import_bundle(spark, store, f"{tmp_path}/one") == {"observations": 0, "covered": 1}
    have, known = bundles.stored(spark, store)
    assert have.agg(F.count("*"), F.sum("output")).first() == (60, sum(r[2] for r in rows))
    assert known.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] == 600
    other = observed.filter("offset = 0").withColumn("output", F.lit(9).cast("long"))
    bundles.write_bundle(other, extents.filter("begin = 0"), f"{tmp_path}/other")
    with pytest.raises(bundles.ConflictingBundle):
        bundles.import_bundle(spark, store, f"{tmp_path}/other")
    observed.filter("offset = 0").write.mode("append").parquet(f"{tmp_path}/one/observations")
    with pytest.raises(bundles.DamagedBundle):
        bundles.read_bundle(spark, f"{tmp_path}/one")
