"""Documents from files, a string or any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path_ord, path, source): each file whole; one that isn't UTF-8 fails the job. Paths keep their order."""
    raw = spark.read.format("binaryFile").load(paths)
    checked = F.when(F.expr("is_valid_utf8(content)"), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
    order = F.create_map(*[x for i, p in enumerate(paths) for x in (F.lit(p), F.lit(i))]) if len(paths) <= 1000 else None
    short = F.regexp_replace("path", "^file:/*", "/")
    place = F.coalesce(order[short], F.lit(len(paths))) if order is not None else F.lit(0)
    return raw.select(place.alias("path_ord"), short.alias("path"), checked.alias("source"))


def read_text(spark: SparkSession, source: str, name: str = "<stdin>") -> DataFrame:
    """One document given as a string; it comes before files."""
    return spark.createDataFrame([(-1, name, source)], "path_ord int, path string, source string")


def from_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(path, source) from any table."""
    return df.select(F.col(key).cast("string").alias("path"), F.col(text).alias("source"))


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a file's lines that are neither blank nor begin with # or -."""
    return spark.read.text(path).where("trim(value) <> '' AND NOT value rlike '^[#-]'").withColumnRenamed("value", "text")


#: Bytes of files for a task. A row group is one task whatever its size, and a kernel needs a second or more for each MB of a packed one.
TASK_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan as it is or, if it has fewer tasks than its files' bytes ask for, or fewer files than there are cores, dealt anew: tasks stay as small as they are, however large the table."""
    cores, tasks = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    wanted = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)
    if tasks < wanted or tasks < 16 * cores and len(df.inputFiles()) < cores:
        return df.repartition(max(4 * cores, wanted))
    return df
