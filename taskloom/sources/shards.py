"""Sharded columnar tables: one directory per shard, read back with pruning."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by the column ``shard``; empty shards get no directory.

    The rebalance hint lets adaptive execution split a large shard over several
    tasks and files, and join small ones, instead of one task per shard.
    """
    df.hint("rebalance", "shard").write.mode(mode).partitionBy("shard").parquet(path)


def read_shards(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None, skip_unreadable: bool = False
) -> DataFrame:
    """Read all shards or an index range; columns are merged.

    An unreadable file stops the job, unless ``skip_unreadable``; ``read_report``
    then tells which files those are.
    """
    reader = spark.read.options(ignoreCorruptFiles=str(skip_unreadable).lower(), mergeSchema="true")
    df = reader.parquet(path)
    if first is not None:
        df = df.where(F.col("shard") >= first)
    if last is not None:
        df = df.where(F.col("shard") <= last)
    return df


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, rows, readable) of every file: one that gives no row is empty or cannot be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    read = read_shards(spark, path, skip_unreadable=True).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    joined = files.withColumn("_p", plain).join(read.select(plain.alias("_p"), "rows"), "_p", "left")
    return joined.select("path", "length", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNotNull().alias("readable"))


def union_inputs(*tables: DataFrame) -> DataFrame:
    """Concatenate tables by name; columns missing somewhere become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def two_way_sink(hinted: DataFrame, classified: DataFrame, path: str) -> None:
    """Rule rows and model rows as JSON lines, one directory per shard each.

    Both inputs carry ``shard``. Overwriting makes a repeated run harmless.
    """
    for name, df in (("rule", hinted), ("model", classified)):
        out = df.hint("rebalance", "shard").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("shard")
        out.json(f"{path}/{name}")
