from pyspark.sql import functions as F

from tokenloom.operators import ordered
from tokenloom.streaming import rollups


def test_buckets_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    rows = events.select(F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp")).alias("ts"), F.floor("value").cast("long").alias("output"))
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    query = rollups.buckets(stream, "ts").writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = sorted(map(tuple, spark.table("buckets").select("start", "requests", "output").collect()))
    want = stored.filter("ts IS NOT NULL").groupBy(F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("output").alias("o"))
    assert got == sorted(map(tuple, want.select("w.start", "n", "o").collect()))
    assert rollups.undated(stored, "ts").count() == stored.filter("ts IS NULL").count()


def _run(stream, path, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    query.awaitTermination(90)


def test_later_revisions_replace_earlier_ones(spark, tmp_path):
    for i, rows in enumerate([[("a", 1, 5), ("b", 1, 7)], [("a", 2, 9)], [("a", 3, 4)]]):
        spark.createDataFrame(rows, "s string, n int, output long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema("s string, n int, output long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    _run(rollups.latest_revisions(stream, ["s"], F.struct("output", "n"), ["n", "output"]), tmp_path / "state", "revisions", "complete")
    assert sorted(map(tuple, spark.table("revisions").collect())) == [("a", 2, 9, 3), ("b", 1, 7, 1)]


def test_running_totals_go_on_over_batches(spark, tmp_path):
    big = 2**53 + 1
    rows = [(s, i, None if i % 4 == 3 else (i % 15) * 2, big + i if i % 2 else None) for s in ("x", "y", None) for i in range(30)]
    for part in range(3):
        here = [r for r in rows if r[1] // 10 == part]
        spark.createDataFrame(here, "s string, i int, a long, b long").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema("s string, i int, a long, b long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    _run(rollups.running_totals(stream, "s", ["i"], ["a", "b"]), tmp_path / "state", "running", "append")
    want = {}
    for s in ("x", "y", None):
        counters = ordered.Counters(["a", "b"])
        want |= {(s, r[1]): tuple(counters.step(r[2:])) for r in rows if r[0] == s}
    got = {(r["s"], r["i"]): tuple(r)[2:] for r in spark.table("running").collect()}
    assert got == want and {e for *_, e, _ in want.values()} >= {"advanced", "reset"}
