"""Session-level helpers: the shared folder and the parallelism to plan for."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Folder per application, for sessions that name none (local runs and tests).
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named and all runs on this machine."""
    found = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if found:
        return found
    master = spark.sparkContext.master or ""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set {_CHECKPOINT} to a folder that driver and executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="taskloom-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors.

    ``free``: shuffle files of the write go when it ends, not when the driver next collects its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _located(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path in shared storage."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _located(spark, path)
    return system.exists(folder)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted, without checksums and unfinished files; none if there is no such folder."""
    system, folder = _located(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(n for n in names if not n.endswith((".crc", ".part")))


def delete(spark: SparkSession, path: str) -> None:
    system, folder = _located(spark, path)
    system.delete(folder, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole or not at all: it gets its name when it is complete."""
    system, target = _located(spark, path)
    _, part = _located(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = system.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(part, target):  # another attempt was first
        system.delete(part, False)


def get_text(spark: SparkSession, path: str) -> str | None:
    """Text of a small file, or None."""
    system, target = _located(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
