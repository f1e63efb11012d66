"""What the operators of this package share: reading, stored tables, words, filters of keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
#: Bits of a filter of keys: a fixed size, whatever the table's.
FILTER_BITS = 1 << 22
#: A key of a join with so many rows, and that share of all rows, is dealt over so many tasks.
HOT, HOT_SHARE, SALTS = 10_000, 1e-4, 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only on a single machine, where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def use_checkpoints(spark: SparkSession) -> None:
    shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the checkpoint folder: they survive lost executors and end the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def store(df: DataFrame, kind: str = "run", group_bytes: int | None = None) -> DataFrame:
    """The rows as a written table in the shared folder.

    Where rows are large, group_bytes bounds what a task holds of them: a writer holds a row group, and a reader of arrays
    decodes up to one at once. Sizes are looked at from the first row on, by default only after 100 rows.
    """
    path = new_folder(df.sparkSession, kind)
    sized = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(compression="zstd", **sized).parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a written table of ours, wherever the shared folder is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*stored: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in stored:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows as one struct column _row, beside columns of our own: no name of theirs can clash with one of ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(v.alias(k) for k, v in more.items()))


def unboxed(rows: DataFrame, like: DataFrame, **more: Column) -> DataFrame:
    """The rows with their own columns and those in `more`, which replace columns of the same name."""
    own = [F.col("_row").getField(c).alias(c) for c in like.columns if c not in more]
    return rows.select(*own, *(v.alias(k) for k, v in more.items()))


def words_of(text: Column) -> Column:
    """Runs of anything but white space, in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def slices(df: DataFrame, parts: int | None = None) -> int:
    """How many partitions a shuffle gets: the session's setting, or more where asked for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), parts or 1)


def mark_of(docs: DataFrame, key: str, text: str) -> Column:
    """Tells rows with the same id apart by their text: 32 and 128 bits in hex, or nothing where no id occurs twice."""
    repeated = docs.groupBy(F.col(f"`{key}`")).count().filter("count > 1").limit(1).count()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    order = F.lpad(F.hex(F.hash(F.col(f"`{text}`")).cast("long") + F.lit(1 << 31)), 8, "0")
    return F.concat(order, F.when(F.col(f"`{text}`").isNull(), "-").otherwise("+"), F.md5(body.cast("binary"))) if repeated else F.lit("")


def salted(large: DataFrame, small: DataFrame, key: str | list[str], spread: Column, how: str = "inner", count: str = "k") -> DataFrame:
    """large joined to the distinct keys of small, whose column `count` says how many rows of large have the key.

    The rows of hot keys are dealt over SALTS tasks, and only those keys are copied as often. A key is hot from HOT rows
    and a HOT_SHARE of all rows on, so no more than 1 / HOT_SHARE keys are, whatever the tables: they are broadcast.
    """
    keys = [key] if isinstance(key, str) else key
    small = store(small, "keys")  # read three times at most, made once
    rows, most = small.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    least = max(HOT, int(rows * HOT_SHARE))
    if most < least:
        return large.join(small.drop(count), keys, how)
    hot = F.broadcast(small.filter(F.col(count) >= least).select(*keys, F.lit(SALTS).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = large.join(hot, keys, "left").withColumn("_salt", F.pmod(spread, salts).cast("int")).drop("_salts")
    right = small.drop(count).join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def filled(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of keys (columns _key and _mark), built by the tasks; the driver gets its words."""
    spots = F.explode(F.array(*(F.pmod(F.xxhash64("_key", "_mark", F.lit(i)), F.lit(bits)) for i in range(2))))
    words = keys.select(spots.alias("s")).groupBy(F.floor(F.col("s") / 32).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(32)).cast("int"))).alias("b"))
    out = np.zeros(bits // 32, dtype=np.uint32)
    for w, b in words.collect():  # at most bits / 32 rows
        out[w] = b
    return out


def may_hold(words: np.ndarray) -> Column:
    """Whether the filter may hold the row's key: never wrong when it says no."""
    bits = 32 * len(words)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for spots in batches:
            inside = np.ones(len(spots[0]), dtype=bool)
            for s in spots:
                at = s.to_numpy()
                inside &= words[at >> 5] >> (at & 31).astype(np.uint32) & 1 == 1
            yield pd.Series(inside)

    return F.pandas_udf(run, "boolean")(*(F.pmod(F.xxhash64("_key", "_mark", F.lit(i)), F.lit(bits)) for i in range(2)))
