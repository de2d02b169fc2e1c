"""All eleven jobs in a row, with stand-ins for the model and the runner."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from taskloom.operators import export, joins, responses
from taskloom.plans import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import test modules
PROSE = "The first carriage went north, then east, and the next one went south after that. " * 8


def _model(prompts):
    return [json.dumps({
        "suitable_types": [2, 3], "reasons": {"2": "prose"}, "text": "Kernel.", "level1": "3", "level2": "3.1", "new": "false",
        "problem": "A story with 7 8 in it.", "input": "7 8", "instrumented_code": "print('[TRACE] sum | v=15'); print(15)",
        "trace_plan": [{"event": "sum"}], "analysis": "adds", "verified": True, "num_steps": 1, "reasoning": "Step 1: The answer is 15.",
    }) for _ in prompts]


def _runner(job):
    if job["code"] == "print(15)":
        return {"return_code": 0, "stdout": "15\n", "stderr": ""}
    return {"return_code": 0, "stdout": "[TRACE] sum | v=15\n15\n", "stderr": ""}


def test_flow(spark, tmp_path):
    work = str(tmp_path / "work")

    def stored(df, name):
        df.write.mode("overwrite").parquet(f"{work}/stored/{name}")
        return spark.read.parquet(f"{work}/stored/{name}")

    raw = spark.range(6).selectExpr(
        "id AS seq", "concat('p', id) AS id", "'c' AS contest_id", "'A' AS index", "concat('T', id) AS title", "'Add two.' AS description",
        "'' AS input_format", "'' AS output_format", "array(named_struct('input', '1 2', 'output', '3')) AS examples", "array('math') AS tags",
        "array(named_struct('source', 'print(15)', 'og_source', '', 'programmingLanguage', 'Python 3', 'submission_id', 's')) AS accepted_solutions",
        "cast(900 AS int) AS rating", "'' AS note")
    labelled = responses.classification_fields(jobs.classify_problems(raw, _model, work), "llm_response")
    assert labelled.select("type_level1").distinct().collect()[0][0] == "3"
    qa = raw.withColumn("question", F.col("description")).join(labelled.select("id", "type_level1", "type_level2"), "id")
    qa = stored(jobs.extract_kernel(qa, _model, work), "qa")
    assert {r.refined_question for r in qa.collect()} == {"Kernel."}

    texts = spark.range(30).selectExpr("id AS doc_id", f"concat(id, ' {PROSE}') AS text", "'news' AS quality_domain_txt")
    classified = stored(jobs.classify_corpus(texts, "doc_id", _model, work), "classified")
    assert classified.count() == 30
    pairs = jobs.synthesize_problems(qa, classified, "doc_id", _model, work, k=2)
    stories = stored(jobs.refine_problems(pairs, _model, work).withColumn("seq", F.hash("id").cast("bigint") * 10 + F.col("sample_idx").cast("bigint")), "stories")
    assert stories.count() == 12 and stories.where("refined_result IS NULL").count() == 0

    solutions = qa.selectExpr("id", "seq", "inline(accepted_solutions)").withColumn("pos", F.lit(0))
    cases = stored(jobs.execute_tests(stories, solutions, qa, _runner, work).withColumn("seq", F.monotonically_increasing_id()), "cases")
    assert {(r.expected_output, r.rating, r.source) for r in cases.collect()} == {("15", 900, "synthesized")} and cases.count() == 12
    assert jobs.generate_tests(qa, _model, work).count() == 6

    codes = stored(responses.instrumented_code(jobs.instrument_code(qa, _model, work).withColumn("seq", F.lit(0).cast("bigint"))), "codes")
    fused = stored(jobs.fuse_inputs(cases, stories, _model, work), "fused")
    inputs = cases.select("problem_id", "source", "input", "expected_output", "seq")
    traces = stored(jobs.execute_instrumented(inputs, codes, _runner, work), "traces")
    assert traces.where("output_matched").count() == 12
    assert jobs.execute_instrumented(inputs, codes, _runner, work, done=traces).count() == 0
    cot = responses.cot_fields(jobs.synthesize_reasoning(fused, traces, codes, _model, work))
    records = export.sft_records(cot)
    assert records.count() == 12
    assert [m.role for m in records.first().messages] == ["user", "assistant"]
    assert joins.trace_candidates(fused, traces, codes).where("trace_status <> 'matched'").count() == 0
