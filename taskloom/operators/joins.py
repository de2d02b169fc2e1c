"""Keyed joins and unions between cases, templates, code and traces."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.hashing import sha_id
from taskloom.functions.text import is_blank, strip, text_or_empty
from taskloom.functions.strict_json import json_fields
from taskloom.operators.numbering import lookup_join, number_rows, range_bucket, spread_join


def round_robin_templates(cases: DataFrame, templates: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """The j-th case of a problem (by ``seq``) takes template j mod m of that problem.

    Cases without a template drop out where the per-problem counts meet the
    numbering, before the wide join.
    """
    stories = templates.select(
        F.col("id").alias("problem_id"), F.col("seq").alias("_tseq"),
        "story_problem", F.col("story_input").alias("original_input"),
    )
    n = F.count(F.lit(1))
    per_problem = (
        stories.groupBy("problem_id").agg(n.alias("_m"))
        .join(cases.groupBy("problem_id").agg(n.alias("_n")), "problem_id")
        .select("problem_id", "_m", (F.col("_n") / F.col("_m") > hot_rows).alias("_hot"))
    )
    numbered = number_rows(
        stories, ["problem_id"], ["_tseq"], range_bucket(stories, "_tseq"), "template_idx",
        attach=per_problem.drop("_m"),
    ).drop("_tseq")
    turns = number_rows(cases, ["problem_id"], ["seq"], range_bucket(cases, "seq"), "_turn", attach=per_problem)
    wanted = turns.withColumn("template_idx", F.pmod("_turn", "_m")).drop("_turn", "_m")
    joined = spread_join(wanted, numbered, ["problem_id", "template_idx"], ["seq"])
    return joined.withColumnRenamed("input", "new_input")


def template_stats(templates: DataFrame) -> DataFrame:
    per_problem = templates.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return per_problem.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("templates"), F.count(F.lit(1)).alias("problems")
    ).withColumn("avg_per_problem", F.col("templates") / F.greatest("problems", F.lit(1)))


def code_join(
    records: DataFrame, codes: DataFrame, key: str, row_id: list[str], hot_rows: int = 1_000_000
) -> DataFrame:
    """Records with the code of their problem; ``code_status`` tells which have none."""
    side = codes.withColumnRenamed("id", key) if key != "id" else codes
    joined = lookup_join(records, side, [key], row_id, "left", hot_rows)
    return joined.withColumn("code_status", F.when(F.col("code").isNull(), "no_code").otherwise("ready"))


def test_input_union(executed: DataFrame, qa: DataFrame, golden: DataFrame) -> DataFrame:
    """Generated, official and synthesized inputs, each with its own filter."""
    def filled(name: str) -> Column:
        return text_or_empty(F.col(name)) != ""

    generated = (
        executed.select("id", F.inline("test_cases"))
        .where((F.col("status") == "success") & filled("input") & filled("output"))
        .select(F.col("id").alias("problem_id"),
                F.concat(F.lit("level_"), F.coalesce("level", F.lit("C"))).alias("source"),
                "input", F.col("output").alias("expected_output"))
    )
    official = (
        qa.select("id", F.inline("official_tests"))
        .where(filled("input") & filled("output"))
        .select(F.col("id").alias("problem_id"), F.lit("official").alias("source"),
                "input", F.col("output").alias("expected_output"))
    )
    synthesized = golden.select(
        text_or_empty(F.col("problem_id")).alias("problem_id"), F.lit("synthesized").alias("source"),
        text_or_empty(F.col("input")).alias("input"),
        text_or_empty(F.col("expected_output")).alias("expected_output"),
    )
    return generated.unionByName(official).unionByName(synthesized)


def _input_key(col: Column) -> Column:
    return F.sha2(strip(F.replace(text_or_empty(col), F.lit("\r"), F.lit(""))), 256)


def first_traces(traces: DataFrame, verified_only: bool = False) -> DataFrame:
    """First non-blank stdout per (problem, source, input) by ``seq``."""
    kept = traces.where(~is_blank(F.col("raw_stdout")))
    if verified_only:
        kept = kept.where("output_matched")
    keyed = kept.select("problem_id", "source", _input_key(F.col("input")).alias("input_key"), "seq", "raw_stdout")
    return keyed.groupBy("problem_id", "source", "input_key").agg(F.min_by("raw_stdout", "seq").alias("raw_stdout"))


def trace_candidates(
    fused: DataFrame, traces: DataFrame, codes: DataFrame,
    verified_only: bool = False, hot_rows: int = 1_000_000,
) -> DataFrame:
    """Every fused case with its trace and code where there are any, and a ``trace_status``:
    bad_story (unparsable or empty problem), no_trace, no_code or matched."""
    story = F.when(F.col("_p.ok"), text_or_empty(F.col("_p.problem")))
    cases = (
        fused.withColumn("_p", json_fields(F.col("fused_result"), "problem"))
        .withColumn("problem", text_or_empty(story)).drop("_p", "fused_result")
        .withColumn("input_key", _input_key(F.col("new_input")))
    )
    with_trace = lookup_join(
        cases, first_traces(traces, verified_only), ["problem_id", "source", "input_key"], ["seq"], "left", hot_rows
    )
    side = codes.select(F.col("id").alias("problem_id"), F.col("code").alias("instrumented_code"))
    with_code = lookup_join(with_trace, side, ["problem_id"], ["seq"], "left", hot_rows, hot_from=fused)
    status = (
        F.when(F.col("problem") == "", "bad_story")
        .when(F.col("raw_stdout").isNull(), "no_trace")
        .when(F.col("instrumented_code").isNull(), "no_code")
        .otherwise("matched")
    )
    return with_code.withColumn("trace_status", status).drop("input_key")


def trace_join(fused: DataFrame, traces: DataFrame, codes: DataFrame, **options) -> DataFrame:
    matched = trace_candidates(fused, traces, codes, **options).where("trace_status = 'matched'")
    return matched.select(
        "eval_id", "seq", "problem_id", "title", "source", "type_id", "rating", "problem",
        F.col("expected_output").alias("answer"), "raw_stdout", "instrumented_code",
    )


def synth_key(problem_id: Column, sample_idx: Column) -> Column:
    return F.concat_ws("::", problem_id, F.lit("synth"), sample_idx.cast("string"))


def trace_key(problem_id: Column, source: Column, n: Column) -> Column:
    """``n`` must be a table-wide ordinal: a per-shard one would collide across shards."""
    return F.concat_ws("::", problem_id, source, n.cast("string"))


def with_run_key(inputs: DataFrame) -> DataFrame:
    """Add ``run_key``: a hash of problem, source, normalised input and, among equal ones, the occurrence by ``seq``."""
    content = sha_id(text_or_empty(F.col("problem_id")), text_or_empty(F.col("source")), _input_key(F.col("input")))
    hashed = inputs.withColumn("_content", content)
    counted = number_rows(hashed, ["_content"], ["seq"], range_bucket(hashed, "seq"), "_nth")
    return counted.withColumn("run_key", F.substring(sha_id(F.col("_content"), F.col("_nth")), 1, 32)).drop("_content", "_nth")


def fuse_funnel(cases: DataFrame, templates: DataFrame) -> DataFrame:
    """Cases by what becomes of them: fused, or left out as their problem has no template."""
    known = templates.select(F.col("id").alias("problem_id")).distinct().withColumn("_known", F.lit(True))
    counts = cases.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n")).join(known, "problem_id", "left")
    status = F.when(F.col("_known"), "fused").otherwise("no_template")
    return counts.groupBy(status.alias("fuse_status")).agg(F.sum("n").alias("n"))
