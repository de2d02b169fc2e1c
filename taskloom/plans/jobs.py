"""The eleven jobs of the flow, each from input tables to its result table.

``complete`` maps prompts to completions, ``run`` executes one program; both are
the caller's. ``work`` is a folder in shared storage, or named ``Stages`` in one:
responses are kept there by request id, so a job that is started again asks only
for what is missing, and a named run also goes on at the stage where it broke.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from taskloom.functions.hashing import sha_id
from taskloom.functions.language import language_runner
from taskloom.functions.text import token_count, truncate
from taskloom.operators import corpus, exchange, joins, pairing, responses, runs, shape
from taskloom.operators.numbering import lookup_join
from taskloom.operators.sharding import resume_antijoin
from taskloom.prompts import STAGES
from taskloom.session import delete, get_text, names_in, put_text

Complete = Callable[[list[str]], list[str]]
Run = Callable[[dict], dict]


class Stages:
    """The stage tables of one run under ``work/runs/<name>``, and which of them are finished.

    A finished stage is recorded with the settings it was made with, once its table is complete. Started again under
    the same name, a run reads finished stages and makes the others anew, in place of what a broken attempt left. So
    name a run by what goes into it (a date, a version of the input). Without a name it is made up, and cannot go on.
    """

    def __init__(self, spark: SparkSession, work: str, name: str | None = None):
        self.spark, self.work = spark, work.rstrip("/")
        self.name = name or f"unnamed-{uuid.uuid4().hex}"
        self.folder = f"{self.work}/runs/{self.name}"

    def stored(self, df: DataFrame, stage: str, settings: str = "", by: str | None = None) -> DataFrame:
        """The rows as the stage's table: what made them runs once. ``by`` names a column to lay it out by."""
        path, mark = f"{self.folder}/{stage}", f"{self.folder}/_finished/{stage}"
        if get_text(self.spark, mark) != settings:
            delete(self.spark, mark)
            out = df.write.mode("overwrite")
            if by:
                self._laid(out.partitionBy(by), path)
            else:
                out.parquet(path)
            put_text(self.spark, mark, settings)
        return self.spark.read.schema(df.schema).parquet(path)

    def _laid(self, out: DataFrameWriter, path: str) -> None:
        """Write a few folders side by side: rows are not sorted by folder first, and neighbours stay so, which compresses."""
        files, conf = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf
        before = conf.get(files)
        conf.set(files, str(4 * exchange.BUCKETS))
        try:
            out.parquet(path)
        finally:
            conf.set(files, before)

    def finished(self) -> list[str]:
        return names_in(self.spark, f"{self.folder}/_finished")

    def clear(self) -> None:
        """Remove the run's stage tables, once nothing reads them any more. Responses stay."""
        delete(self.spark, self.folder)


def clear_unnamed(spark: SparkSession, work: str) -> None:
    """Remove the stage tables of all runs without a name."""
    for name in names_in(spark, f"{work.rstrip('/')}/runs"):
        if name.startswith("unnamed-"):
            Stages(spark, work, name).clear()


def _stages(work: "str | Stages", df: DataFrame) -> Stages:
    return work if isinstance(work, Stages) else Stages(df.sparkSession, work)


def ask(
    rows: DataFrame, stage: str, key: Sequence[str], values: dict[str, Column], complete: Complete,
    work: str | Stages, out: str, gated: bool = False, template: str | None = None, waves: int | None = None,
    token_len: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """Render, store, send, keep and attach: the core of every model job.

    The rows are stored first with their request ids, so that what made them runs
    once; the prompt, which repeats their texts, is rendered again where it is sent. Rows with equal ``key`` and prompt share one answer and stay
    as many as they were. Rows that the length gate holds back get ``''`` and
    leave nothing in the response table.
    """
    s = STAGES[stage]
    prompt = exchange.render_prompt(template or s.template, [(n, values[n]) for n in s.placeholders])
    reqs = exchange.requests(rows, stage, key, prompt)
    if gated:
        reqs = exchange.length_gate(reqs, s.max_model_len, s.max_tokens, token_len)
    else:
        reqs = reqs.withColumn("sendable", F.lit(True))
    run = _stages(work, rows)
    buckets = exchange.ResponseStore(run.spark, f"{run.work}/{stage}", buckets=waves or exchange.BUCKETS).buckets
    settings = f"{stage}|{exchange.settings_text(stage)}|{','.join(key)}|{buckets}|{hashlib.md5((template or s.template).encode()).hexdigest()}"
    reqs = exchange.with_bucket(reqs.select(*rows.columns, "request_id", "sendable"), buckets)
    reqs = run.stored(reqs, stage, settings, "bucket")
    table = exchange.exchange_through(
        reqs.where("sendable").select("request_id", prompt.alias("prompt"), "bucket"), f"{run.work}/{stage}",
        lambda todo: exchange.infer_batches(todo, complete, s.batch_size), waves=waves, dealt=buckets,
    )
    answered = exchange.attach_responses(reqs.select(*rows.columns, "request_id", "sendable"), table, out)
    return answered.withColumn(out, F.when(F.col("sendable"), F.col(out)).otherwise("")).drop("request_id", "sendable")


def classify_problems(problems: DataFrame, complete: Complete, work: str | Stages) -> DataFrame:
    """Raw problems → question, tags, editorial and ``llm_response``."""
    rows = problems.select(
        "id", "contest_id", "index", "title", shape.problem_text_classify().alias("question"),
        shape.tags_text().alias("tags"), shape.editorial_text().alias("editorial"), "rating",
    )
    values = {n: F.col(n) for n in STAGES["classify_problem"].placeholders}
    return ask(rows, "classify_problem", ["id"], values, complete, work, "llm_response")


def extract_kernel(problems: DataFrame, complete: Complete, work: str | Stages) -> DataFrame:
    """Problems with ``question`` → the same with ``refined_question``."""
    asked = ask(problems.drop("refined_question"), "extract_kernel", ["id"], {"question": F.col("question")}, complete, work, "raw")
    return responses.kernel_text(asked).drop("raw")


def classify_corpus(texts: DataFrame, key: str, complete: Complete, work: str | Stages, max_len: int = 2048) -> DataFrame:
    """Corpus texts → hinted rows under ``work/rule`` and classified rows."""
    spark = texts.sparkSession
    hinted = corpus.rule_filter(corpus.rule_hints(corpus.corpus_features(texts)))
    kept = hinted.select(key, truncate(F.col("text"), max_len).alias("text"), "rule_hints")
    run = _stages(work, texts)
    kept.write.mode("overwrite").parquet(f"{run.work}/rule")
    rule = spark.read.parquet(f"{run.work}/rule")
    values = {"text": F.col("text"), "rule_hints": exchange.hints_text(F.col("rule_hints"))}
    asked = ask(rule, "classify_corpus", [key], values, complete, run, "raw")
    return corpus.classified_corpus(rule, asked.select(key, "raw"), key)


def synthesize_problems(
    qa: DataFrame, classified: DataFrame, corpus_id: str, complete: Complete, work: str | Stages,
    k: int = 1, strict: bool = False, lang: str = "en", seed: int = 42,
) -> DataFrame:
    """Problems × texts of their type → pairs with ``synthesis_result``. ``classified`` is a stored table."""
    problems = qa.select(
        "id", "contest_id", "index", "title", "type_level1", "type_level2", shape.problem_text().alias("original_problem")
    )
    usable = classified.where(F.size("suitable_types") > 0)
    pairs = pairing.typed_pairs(
        problems, corpus.type_listing(usable, corpus_id), corpus.corpus_texts(usable, corpus_id), k, strict=strict, seed=seed
    )
    values = {
        "type_id": F.col("type_id"), "type_instruction": exchange.type_instruction(F.col("type_id"), lang),
        "text": F.col("corpus_text"), "problem": F.col("original_problem"),
    }
    return ask(pairs, "synthesize", ["id", "sample_idx"], values, complete, work, "synthesis_result")


def refine_problems(pairs: DataFrame, complete: Complete, work: str | Stages) -> DataFrame:
    drafts = responses.draft_and_input(pairs)
    values = {"draft_problem": F.col("draft_problem"), "input": F.col("draft_input"), "corpus": F.col("corpus_text")}
    return ask(drafts, "refine", ["id", "sample_idx"], values, complete, work, "refined_result").drop("draft_problem", "draft_input")


def _solution_jobs(qa: DataFrame, run: Stages, stage: str, **limits) -> DataFrame:
    """Usable solutions with the full text of their problem, numbered per record: ids may repeat."""
    records = run.stored(qa.withColumn("record", F.monotonically_increasing_id()), f"{stage}-records")
    rows = shape.solution_rows(records, ["record", "id"]).where("pos IS NOT NULL")
    solutions = shape.expand_solutions(rows, key="record", **limits)
    problems = records.select("record", "contest_id", "index", "title", "type_level1", shape.problem_text(with_note=True).alias("problem"))
    return lookup_join(solutions.drop("source", "og_source", "pos"), problems, ["record"], ["solution_idx"]).drop("record")


def _about_code(stage: str, out: str) -> Callable[..., DataFrame]:
    def job(qa: DataFrame, complete: Complete, work: str | Stages, **limits) -> DataFrame:
        values, run = {n: F.col(n) for n in STAGES[stage].placeholders}, _stages(work, qa)
        return ask(_solution_jobs(qa, run, stage, **limits), stage, ["id", "solution_idx"], values, complete, run, out)

    return job


generate_tests = _about_code("generate_tests", "generate_test_result")
instrument_code = _about_code("instrument", "instrument_result")


def _run_through(jobs: DataFrame, run: Run, work: str | Stages, name: str) -> DataFrame:
    """Run what ``work`` does not hold yet. Failures are not kept, so they are tried again."""
    def answer(todo: DataFrame) -> DataFrame:
        return exchange.run_batches(todo, run).where("success")

    stages = _stages(work, jobs)
    buckets = exchange.ResponseStore(stages.spark, f"{stages.work}/{name}", exchange.RUNS).buckets
    jobs = stages.stored(exchange.with_bucket(jobs, buckets), name, str(buckets), "bucket")
    sent = jobs.select("request_id", "code", "language", "stdin", "bucket")
    table = exchange.exchange_through(sent, f"{stages.work}/{name}", answer, exchange.RUNS, dealt=buckets)
    return jobs.drop("stdin", "bucket").join(table.select("request_id", "success", "return_code", "stdout"), "request_id")


def execute_tests(stories: DataFrame, solutions: DataFrame, qa: DataFrame, run: Run, work: str | Stages) -> DataFrame:
    """Story inputs through accepted code → eval cases with golden outputs.

    ``solutions`` has (id, seq, pos, source, programmingLanguage); ``qa`` has (id, seq, rating).
    """
    records = responses.synth_records(stories).drop("rating")
    row = ["id", "sample_idx"]
    with_code = joins.code_join(records, shape.first_code(solutions), "id", row).where("code_status = 'ready'")
    rated = lookup_join(with_code, shape.rating_lookup(qa), ["id"], row, "left")
    jobs = rated.select(
        joins.synth_key(F.col("id"), F.col("sample_idx")).alias("request_id"), F.col("id").alias("problem_id"), "title",
        "type_id", "problem", "input", F.col("input").alias("stdin"), F.coalesce("rating", F.lit(0)).alias("rating"),
        "code", language_runner(F.col("programmingLanguage")).alias("language"),
    )
    golden = runs.golden_outputs(_run_through(jobs, run, work, "golden"))
    return golden.select(F.col("request_id").alias("eval_id"), "problem_id", "title", "source", "type_id", "problem",
                         "input", "expected_output", "rating")


def fuse_inputs(cases: DataFrame, stories: DataFrame, complete: Complete, work: str | Stages) -> DataFrame:
    """Cases (with ``seq``) in rotation over the story templates (with ``seq``) → ``fused_result``."""
    templates = responses.story_templates(stories).select("id", "seq", "story_problem", "story_input")
    rows = joins.round_robin_templates(cases.drop("problem"), templates)
    values = {"problem": F.col("story_problem"), "original_input": F.col("original_input"), "new_input": F.col("new_input")}
    return ask(rows, "fuse_input", ["eval_id"], values, complete, work, "fused_result")


def execute_instrumented(inputs: DataFrame, codes: DataFrame, run: Run, work: str | Stages, done: DataFrame | None = None) -> DataFrame:
    """Test inputs (with ``seq``) through instrumented code → trace runs. Mismatches stay, flagged.

    ``done`` holds trace runs that need not be made again. They are told by what
    was run, so adding inputs anywhere leaves them valid.
    """
    keyed = joins.with_run_key(inputs).withColumn("trace_id", joins.trace_key(F.col("problem_id"), F.col("source"), F.col("run_key")))
    todo = resume_antijoin(keyed, done, "trace_id") if done is not None else keyed
    ready = joins.code_join(todo, codes.drop("trace_plan"), "problem_id", ["seq"]).where("code_status = 'ready'")
    # The id covers the content, so a changed input or program is run again.
    jobs = ready.withColumn("request_id", sha_id(F.col("trace_id"), F.col("input"), F.col("code"))).withColumn("stdin", F.col("input"))
    done_runs = _run_through(jobs.drop("run_key"), run, work, "traces").where(F.col("stdout") != "")
    judged = runs.output_match(runs.split_trace(done_runs))
    return judged.select("trace_id", "seq", "problem_id", "source", "input", "expected_output", "actual_output",
                         "output_matched", "traces", F.col("stdout").alias("raw_stdout"), "analysis")


def synthesize_reasoning(
    fused: DataFrame, traces: DataFrame, codes: DataFrame, complete: Complete, work: str | Stages, verified_only: bool = False
) -> DataFrame:
    """Fused cases with their traces and code → ``cot_result``; over-long prompts stay with an empty one."""
    rows = joins.trace_join(fused, traces, codes, verified_only=verified_only)
    values = {n: F.col(n) for n in STAGES["reasoning"].placeholders}
    return ask(rows, "reasoning", ["eval_id"], values, complete, work, "cot_result", gated=True)
