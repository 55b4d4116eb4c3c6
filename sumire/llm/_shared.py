"""What the operators share: tables, the cluster's shared folder, Arrow maps, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where none is set, one of this machine's if all of Spark runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sumire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a kernel that is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for b in batches:
            yield kernel(b)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to be added: those given, with underscores before them where df has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of the undirected edges (a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014) over written tables: every
    join reads two exchanges, so that adaptive execution can split a hot centre, and only minima are
    aggregated. A logarithmic number of rounds is usual; the loop ends when a round changes nothing
    and fails rather than return unfinished labels.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark = None
    for _ in range(rounds):
        # large star: a larger neighbour v of u moves to the smallest neighbour of u, if that is below u
        low = scratch.save(e.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("m")))
        big = e.join(low, "u", "left").select("v", F.coalesce("m", "u").alias("u"))
        e1 = scratch.save(big.distinct())
        # small star: every smaller neighbour of v, and v itself, move to the smallest of them
        least = scratch.save(e1.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
        many = e1.join(least.where("n > 1"), "v").where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        e2 = scratch.save(least.select("v", F.col("m").alias("u")).union(many).distinct())
        for x in (e, low, e1, least):
            scratch.drop(x)
        e = e2
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
