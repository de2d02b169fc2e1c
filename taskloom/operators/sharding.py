"""Shards, fixed batches and resume by anti-join."""

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.operators.numbering import dense_ordinal
from taskloom.session import delete, exists, names_in


def shard_contiguous(df: DataFrame, seq: str, n_shards: int) -> DataFrame:
    """Balanced contiguous shards; the first n mod N shards hold one row more."""
    rows = dense_ordinal(df, seq, total="_total")
    base = F.floor(F.col("_total") / n_shards)
    longer = F.pmod(F.col("_total"), F.lit(n_shards))
    head = longer * (base + 1)
    shard = F.when(F.col("ord") < head, F.floor(F.col("ord") / (base + 1))).otherwise(
        longer + F.floor((F.col("ord") - head) / F.greatest(base, F.lit(1)))
    )
    return rows.withColumn("shard", shard.cast("int")).drop("_total")


def shard_ceil(df: DataFrame, seq: str, n_shards: int) -> DataFrame:
    """Shards of ceil(n / N) rows; trailing shards may be empty."""
    rows = dense_ordinal(df, seq, total="_total")
    per = F.ceil(F.col("_total") / n_shards)
    return rows.withColumn("shard", F.floor(F.col("ord") / per).cast("int")).drop("_total")


def shard_modulo(df: DataFrame, seq: str, n_shards: int) -> DataFrame:
    """Row number modulo N. Number before dropping rows: bad lines count too."""
    rows = dense_ordinal(df, seq)
    return rows.withColumn("shard", F.pmod("ord", F.lit(n_shards)).cast("int"))


def request_batches(df: DataFrame, seq: str, batch_size: int) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows as a column, for batch-wise output layout.

    Inside a task, ``exchange`` cuts the rows it receives without numbering them.
    """
    rows = dense_ordinal(df, seq)
    return rows.withColumn("batch", F.floor(F.col("ord") / batch_size))


def resume_antijoin(jobs: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Jobs whose key is not yet in the output. Failed rows are never written, so they come again."""
    keys = [key] if isinstance(key, str) else list(key)
    return jobs.join(done.select(*keys), keys, "left_anti")


class DoneKeys:
    """Keys of finished rows, stored in buckets of their hash: a resume shuffles the jobs and never the history.

    ``path/buckets=<n>/gen=<g>`` holds one file a bucket and append, as an external bucketed table that any session can
    open; the number of buckets is fixed with the first keys. ``compact`` writes the next generation with distinct keys
    and one file a bucket; it counts once it is complete, and the one before stays until the next.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "request_id", buckets: int = 64):
        found = [n for n in names_in(spark, path) if n.startswith("buckets=")]
        self.spark, self.key = spark, key
        self.buckets = int(found[0].split("=")[1]) if found else buckets
        self.root = f"{path}/buckets={self.buckets}"

    def _generations(self) -> list[int]:
        found = [int(n.split("=")[1]) for n in names_in(self.spark, self.root) if n.startswith("gen=")]
        return sorted(g for g in found if g == 0 or exists(self.spark, f"{self.root}/gen={g}/_SUCCESS")) or [0]

    def _table(self, generation: int) -> str:
        place = f"{self.root}/gen={generation}"
        name = "done_" + hashlib.md5(place.encode()).hexdigest()
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (`{self.key}` STRING) USING parquet "
                       f"CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(name)  # other sessions may have added files
        return name

    def read(self) -> DataFrame:
        return self.spark.table(self._table(self._generations()[-1]))

    def _insert(self, keys: DataFrame, generation: int) -> None:
        # Spark deals rows to tasks and to buckets by the same hash, so a task writes whole buckets.
        keys.select(F.col(self.key).cast("string")).repartition(self.buckets, self.key).write.insertInto(self._table(generation))

    def add(self, keys: DataFrame) -> None:
        self._insert(keys, self._generations()[-1])

    def todo(self, jobs: DataFrame) -> DataFrame:
        """Jobs whose key is not among those done."""
        return jobs.join(self.read(), self.key, "left_anti")

    def files(self) -> int:
        return len([n for n in names_in(self.spark, f"{self.root}/gen={self._generations()[-1]}") if n.endswith(".parquet")])

    def compact(self) -> None:
        generations = self._generations()
        following = generations[-1] + 1
        delete(self.spark, f"{self.root}/gen={following}")  # what a broken compaction left
        self._insert(self.read().distinct(), following)
        for old in generations[:-1]:
            delete(self.spark, f"{self.root}/gen={old}")
