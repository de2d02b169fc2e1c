"""Counts that a write yields on the way, without a second pass over its rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def kept_and_counts(rows: DataFrame, status: str, values: Sequence[str], path: str, kept: Sequence[str] = ("kept",)) -> tuple[DataFrame, dict[str, int]]:
    """Write the rows of some statuses, and return their table and the rows of every status that occurs.

    ``values`` lists all statuses that the column can have, a handful of them. One job reads the rows once: they are
    counted where they pass on their way to the filter and the write.
    """
    spark, seen = rows.sparkSession, Observation()
    metrics = [F.count_if(F.col(status) == v).alias(f"n{i}") for i, v in enumerate(values)]
    passed = rows.observe(seen, *metrics).where(F.col(status).isin(*kept)).drop(status)
    passed.write.parquet(path)
    counts = {v: seen.get[f"n{i}"] for i, v in enumerate(values)}
    return spark.read.schema(passed.schema).parquet(path), {v: n for v, n in counts.items() if n}
