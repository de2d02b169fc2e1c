"""Resumable corpus intake on Structured Streaming.

The stream's checkpoint replaces a line counter: each input file belongs to one
micro-batch. Both sinks of a batch count from the moment it is entered in
``out/_commits``, which is when both are complete: a batch that broke off in
between is not seen by ``taken_in``, and is written anew; one that is entered is
never written again.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from taskloom.operators.corpus import classified_corpus, corpus_features, rule_filter, rule_hints
from taskloom.operators.exchange import infer_batches, render_corpus_prompt, requests
from taskloom.prompts import STAGES
from taskloom.session import exists, names_in, put_text
from taskloom.sources.jsonl import spread


#: Files of one micro-batch: what a crash can cost at most.
FILES_PER_BATCH = 64


def corpus_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = FILES_PER_BATCH, **options: str
) -> DataFrame:
    """A file stream in bounded micro-batches, each of which is committed on its own."""
    options = {"maxFilesPerTrigger": str(files_per_batch), **options}
    return spark.readStream.format(fmt).options(**options).schema(schema).load(path)


def intake(
    source: DataFrame,
    out: str,
    checkpoint: str,
    key: str,
    complete: Callable[[list[str]], list[str]] | None = None,
    domain: str = "quality_domain_txt",
    max_len: int = 2048,
) -> StreamingQuery:
    """Process what is new and stop.

    Without ``complete`` the hinted rows are written under ``out/rule``; with it
    each batch also asks the model and writes ``out/model``. The rule rows are
    written first and the model stage reads them back, so features are computed
    once and the text is cut before it crosses into Python. ``key`` is the
    unique column of the source.
    """
    columns = [c for c in source.columns if c != "text"]

    def write(batch: DataFrame, batch_id: int) -> None:
        if not exists(batch.sparkSession, f"{out}/_commits/{batch_id}"):
            sinks(batch, batch_id)
            put_text(batch.sparkSession, f"{out}/_commits/{batch_id}", "")

    def sinks(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rule_path = f"{out}/rule/batch_id={batch_id}"
        hinted = rule_filter(rule_hints(corpus_features(spread(batch)), domain))
        cut = F.substring("text", 1, max_len).alias("text")
        hinted.select(*columns, cut, "rule_hints").write.mode("overwrite").parquet(rule_path)
        if complete is None:
            return
        rule = spark.read.parquet(rule_path)
        stage = STAGES["classify_corpus"]
        prompt = render_corpus_prompt(stage.template, F.col("text"), F.col("rule_hints"), max_len)
        asked = requests(rule, "classify_corpus", [key], prompt)
        answers_path = f"{out}/answers/batch_id={batch_id}"
        infer_batches(asked, complete, stage.batch_size).write.mode("overwrite").parquet(answers_path)
        rows = classified_corpus(asked, spark.read.parquet(answers_path), keep=(key,))
        rows.write.mode("overwrite").parquet(f"{out}/model/batch_id={batch_id}")

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def taken_in(spark: SparkSession, out: str, sink: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a sink (``rule`` or ``model``) of all committed batches, with their ``batch_id``."""
    folders = [f"{out}/{sink}/batch_id={n}" for n in names_in(spark, f"{out}/_commits")]
    if not folders:
        return spark.createDataFrame([], schema or T.StructType())
    reader = spark.read.option("basePath", f"{out}/{sink}")
    return (reader.schema(schema) if schema else reader).parquet(*folders)
