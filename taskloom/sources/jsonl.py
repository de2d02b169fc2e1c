"""JSON-lines files with the three bad-line policies, in order, and appended once."""

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.functions.strict_json import one_object, typed_value
from taskloom.functions.text import computed_once, strip
from taskloom.session import exists, names_in, put_text


def read_jsonl(
    spark: SparkSession, paths: str | list[str], schema: str, bad_lines: str = "fail", glob: str = "*.jsonl", seq: str | None = None
) -> DataFrame:
    """Read files, or those of directories that match ``glob``; blank lines are skipped.

    ``bad_lines``: ``fail`` stops the job, ``drop`` leaves the line out, ``keep``
    gives an all-null record that still counts (with ``_bad_line`` holding it).
    A value of another type than the schema's is null; it does not make a line bad.
    ``seq`` names a column for the number of the line among all that are not blank, bad ones included: files by
    name, then by place, however the files are split.
    """
    if bad_lines not in ("fail", "drop", "keep"):
        raise ValueError(f"unknown bad-line policy {bad_lines!r}")
    record = spark.createDataFrame([], schema).schema
    text = spark.read.option("pathGlobFilter", glob).text(paths)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")] if seq else []
    lines = text.select(strip(F.col("value")).alias("_line"), *place).where(F.col("_line") != "")
    rows = (numbered_lines(lines) if seq else lines).withColumn("_r", computed_once(one_object(F.col("_line"))))
    rows = rows.withColumn("_bad_line", F.when(F.col("_r").isNull(), F.col("_line")))
    if bad_lines == "fail":
        stop = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("_bad_line")))
        rows = rows.where(F.when(F.col("_bad_line").isNotNull(), stop.cast("boolean")).otherwise(True))
    elif bad_lines == "drop":
        rows = rows.where(F.col("_bad_line").isNull())
    kept = [typed_value(F.col("_r"), f.name, f.dataType).alias(f.name) for f in record.fields]
    return rows.select(*kept, *(["_bad_line"] if bad_lines == "keep" else []), *([F.col("_seq").alias(seq)] if seq else []))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Add ``_seq`` = 0, 1, 2, … to a scan of lines with ``_file`` and ``_block``, in two levels, without moving a line.

    A block's lines lie one after the other in their task, so the place of a line in its block is its row id less
    that of the block's first line. The lines before a block come from a table with a row a block. Files must not
    change between the count and the read.
    """
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    blocks = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a file in the window over all; one row a block of a file in the other.
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", ahead(Window.orderBy("_file")).alias("_before"))
    inside = blocks.withColumn("_inside", ahead(Window.partitionBy("_file").orderBy("_block"))).drop("_n")
    starts = inside.join(files, "_file").select("_file", "_block", (F.col("_before") + F.col("_inside") - F.col("_first")).alias("_start"))
    return placed.join(starts, ["_file", "_block"]).select("_line", (F.col("_start") + F.col("_at")).alias("_seq"))


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Repartition for costly per-row work, only where the input has fewer splits than cores.

    Splits say little of a file with few row groups, which leaves most of its splits empty, and of rows that become
    large. With ``rows`` a table of narrow rows is always dealt out, to tasks of some so many rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        return df.repartition(max(cores, -(-df.count() // rows)), *keys)  # counted in the footers of the files
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def with_seq(df: DataFrame, out: str = "seq") -> DataFrame:
    """Unique increasing bigint for records that carry no key of their own.

    It follows the scan's split order and is stable for unchanged files and
    settings; write the result before relying on it in two jobs.
    """
    return df.withColumn(out, F.monotonically_increasing_id())


def append_jsonl(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append records as UTF-8 JSON lines; a failed task leaves no partial file behind.

    With ``batch`` they are appended once: the batch has a folder of its own and is entered in ``path/_commits`` when
    it is complete. A batch that is entered is left alone (False); one that broke off is written anew.
    ``appended`` reads the entered batches.
    """
    out = df.write.option("ignoreNullFields", "false")
    if batch is None:
        out.mode("append").json(path)
        return True
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    spark, mark = df.sparkSession, f"{path}/_commits/{batch}"
    if exists(spark, mark):
        return False
    out.mode("overwrite").json(f"{path}/batch={batch}")
    put_text(spark, mark, "")
    return True


def appended(spark: SparkSession, path: str, schema: str, bad_lines: str = "fail", seq: str | None = None) -> DataFrame:
    """Records of all batches that were appended to the end."""
    batches = names_in(spark, f"{path}/_commits")
    if not batches:
        return read_nothing(spark, schema, bad_lines, seq)
    return read_jsonl(spark, [f"{path}/batch={b}" for b in batches], schema, bad_lines, "*.json", seq)


def read_nothing(spark: SparkSession, schema: str, bad_lines: str, seq: str | None) -> DataFrame:
    more = ", _bad_line string" if bad_lines == "keep" else ""
    return spark.createDataFrame([], schema + more + (f", {seq} bigint" if seq else ""))
