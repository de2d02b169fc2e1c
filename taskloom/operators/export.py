"""Training records and the yield of each stage."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions.text import is_blank
from taskloom.operators.exchange import chat_messages


def sft_records(cot: DataFrame) -> DataFrame:
    """Verified rows with reasoning, as a user and an assistant message."""
    kept = cot.where(F.col("verified") & ~is_blank(F.col("reasoning")))
    answer = F.array(F.struct(F.lit("assistant").alias("role"), F.col("reasoning").alias("content")))
    return kept.select(
        "eval_id", "problem_id", "type_id", "rating",
        F.concat(chat_messages(F.col("problem")), answer).alias("messages"),
    )


def stage_yield(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per type and stage, one column per stage; missing counts are 0.

    Each stage is counted on its own (partial aggregation) and tagged, so the
    stages meet as a handful of rows instead of in full outer joins.
    """
    tagged = None
    for name, df in stages.items():
        part = df.groupBy("type_id").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("type_id").agg(*[
        F.sum(F.when(F.col("stage") == name, F.col("n")).otherwise(0)).alias(name) for name in stages
    ])
