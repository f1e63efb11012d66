"""Connected components and descendants, as iterated joins with results stored between rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import joins


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only where none is named."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The same rows from the cluster's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the checkpoint folder: each is made once, where a checkpoint makes it twice."""
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def hashed(node: Column, salt: int) -> Column:
    """64 bits of a node; with a salt they are made of a digest, so no choice of nodes makes them clash."""
    return F.xxhash64(F.sha2(F.concat_ws(":", F.lit(str(salt)), node.cast("string")), 256)) if salt else F.xxhash64(node)


def numbering(nodes: DataFrame) -> Callable[[Column], Column]:
    """What numbers nodes (column node, repeats allowed) so that no two share a number: their hash, salted anew while any two clash."""
    seen = nodes.distinct()
    for salt in count():
        ids = seen.select(hashed(F.col("node"), salt).alias("id")).groupBy("id").count()
        if ids.filter("count > 1").isEmpty():
            return lambda node: hashed(node, salt)  # noqa: B023


def representatives(links: DataFrame) -> DataFrame:
    """(node, rep) of the nodes that links between different whole numbers (columns a and b) join; those of a component, and only they, share a rep.

    In every round a node moves to the one of least hash among itself and its neighbours, links follow their ends, and those within a
    node go. The hash of a number is one-to-one, so it names the node in the next round, where its own hash is a new lot. Of a chain a round
    leaves half the nodes on average, so all rounds together cost as much as a few over all links; their number grows with the logarithm
    of the largest component. A round whose nodes have many neighbours deals the links of each over tasks.
    """
    spark, moves = links.sparkSession, []
    links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        around = links.select(F.col("a").alias("node"), F.col("b").alias("m")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("m")))
        least = around.groupBy("node").agg(F.min(F.xxhash64("m")).alias("least"), F.count("*").alias("d"))
        to = written(least.select("node", F.least("least", F.xxhash64("node")).alias("rep"), "d"))
        most = to.agg(F.max("d")).first()[0]
        if most is None:
            break
        hot, to, spent = most >= joins.HOT, to.drop("d"), [links]
        moves.append((to, hot))
        for end in ("a", "b"):
            move = to.select(F.col("node").alias(end), "rep")
            if hot:
                if end == "b":  # counted before they are dealt
                    links = written(links)
                    spent.append(links)
                links = joins.dealt_join(links, move, [end], F.xxhash64("a", "b"))
            else:
                links = links.join(move, end)
            links = links.drop(end).withColumnRenamed("rep", end)
        links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(*spent)
    if not moves:
        return spark.createDataFrame([], "node long, rep long")
    found, _ = moves.pop()
    for rounds, (to, hot) in enumerate(reversed(moves), 1):
        last = F.col("rep")
        for _ in range(rounds):  # a rep without links is named as the last round would name it
            last = F.xxhash64(last)
        later = found.select(F.col("node").alias("rep"), F.col("rep").alias("later"))
        met = joins.dealt_join(to, later, ["rep"], F.xxhash64("node"), "left") if hot else to.join(later, "rep", "left")
        found = met.select("node", F.coalesce("later", last).alias("rep"))
    return found


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges; the root is the smallest node that links reach. An edge that lacks an end is none."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    number = numbering(nodes)
    reps = representatives(pairs.select(number(F.col("a")).alias("a"), number(F.col("b")).alias("b")))
    named = nodes.select(F.col("node").alias("name"), number(F.col("node")).alias("node"))
    return with_roots(named.join(reps, "node", "left"), "name").select(F.col("name").alias("node"), "root")


def with_roots(rows: DataFrame, name: str) -> DataFrame:
    """The rows with root: the smallest name of the rows with their rep, or their own where they have none."""
    rows = written(rows)
    roots = rows.filter("rep IS NOT NULL").groupBy("rep").agg(F.min(name).alias("root"))
    spread = F.xxhash64(name)
    return joins.dealt_join(rows, roots, ["rep"], spread, "left").withColumn("root", F.coalesce("root", name))


def descendants(edges: DataFrame, seeds: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node, depth) of the seeds (column node) and all that edges reach; a node met before isn't followed again."""
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    reached = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = reached, 0
    while not front.isEmpty():
        depth += 1
        step = front.join(edges, F.col("node") == F.col(parent)).select(F.col(child).alias("node")).distinct()
        found = step.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth))
        # however many rounds there are, the partitions don't add up
        reached = stored(reached.unionByName(found).coalesce(parts))
        front = reached.filter(F.col("depth") == depth)
    return reached
